"""reelsight: ratings analytics and hybrid scoring as Spark DataFrame jobs.

Every public operator is a function from DataFrame(s) to DataFrame, written
with the DataFrame / SQL / ML / Structured Streaming APIs so the work stays
distributed and Catalyst can prune, push down and re-plan it.

Sub-packages
------------
``sources``    readers and writers (text, CSV, JSON, Parquet, models)
``functions``  column expressions (parsing, lookups, scaling, blending)
``operators``  cleaning, joins, aggregates, ordering, genres, features,
               models, hybrid scoring, recommendation
``plans``      the driver-table stand-ins and the registered query catalogue
``streaming``  request scoring over a file-source stream
"""

from reelsight.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
