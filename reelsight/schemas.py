"""Declared schemas for every input the library reads (no inference).

Fixed values: field names and types are those of the input files and of the
request record.  Ids are BIGINT.
"""

from pyspark.sql import types as T

# Ratings text file, '::'-separated: UserID::MovieID::Rating::Timestamp
RATINGS_TEXT = T.StructType([
    T.StructField("UserID", T.LongType(), False),
    T.StructField("MovieID", T.LongType(), False),
    T.StructField("Rating", T.IntegerType(), True),
    T.StructField("Timestamp", T.LongType(), True),
])

# Titles text file: MovieID::Title::Genres
TITLES_TEXT = T.StructType([
    T.StructField("MovieID", T.LongType(), False),
    T.StructField("Title", T.StringType(), True),
    T.StructField("Genres", T.StringType(), True),
])

# Users text file: UserID::Gender::Age::Occupation::Zip_Code (zip stays text)
USERS_TEXT = T.StructType([
    T.StructField("UserID", T.LongType(), False),
    T.StructField("Gender", T.StringType(), True),
    T.StructField("Age", T.IntegerType(), True),
    T.StructField("Occupation", T.IntegerType(), True),
    T.StructField("Zip_Code", T.StringType(), True),
])

# JSON-lines title metadata (the fields the jobs use)
METADATA_JSON = T.StructType([
    T.StructField("title", T.StringType(), True),
    T.StructField("directedBy", T.StringType(), True),
    T.StructField("starring", T.StringType(), True),
    T.StructField("avgRating", T.DoubleType(), True),
    T.StructField("imdbId", T.StringType(), True),
])

# Landed title details: all strings, as fetched
DETAILS = T.StructType([
    T.StructField("localized_title", T.StringType(), True),
    T.StructField("runtimes", T.StringType(), True),
    T.StructField("rating_imdb", T.StringType(), True),
    T.StructField("plot_outline", T.StringType(), True),
    T.StructField("director", T.StringType(), True),
    T.StructField("imdbID", T.StringType(), True),
])

# Raw fetched detail records: list-valued fields, a fetch time, maybe failed (NULL)
DETAILS_RAW_JSON = T.StructType([
    T.StructField("imdbID", T.StringType(), True),
    T.StructField("localized_title", T.StringType(), True),
    T.StructField("runtimes", T.ArrayType(T.StringType()), True),
    T.StructField("rating", T.StringType(), True),
    T.StructField("plot_outline", T.StringType(), True),
    T.StructField("director", T.ArrayType(T.StringType()), True),
    T.StructField("fetched_at", T.TimestampType(), True),
])

# A scoring request: every field but the item optional
REQUEST_SCHEMA = T.StructType([
    T.StructField("RequestID", T.LongType(), True),
    T.StructField("UserID", T.LongType(), True),
    T.StructField("MovieID", T.LongType(), False),
    T.StructField("Gender", T.StringType(), True),
    T.StructField("Occupation", T.StringType(), True),
    T.StructField("Age", T.IntegerType(), True),
    T.StructField("Genres", T.StringType(), True),
    T.StructField("Year", T.IntegerType(), True),
    T.StructField("Runtime", T.IntegerType(), True),
    T.StructField("IMDBRating", T.DoubleType(), True),
])
