"""Column expressions and fixed lookup values."""

from reelsight.functions.lookups import MOVIE_GENRES, OCCUPATION_NAMES  # noqa: F401
from reelsight.functions.scalars import *  # noqa: F401,F403
