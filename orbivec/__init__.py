"""orbivec: vector search as batch and streaming jobs on Spark DataFrames."""

from orbivec.functions.vectors import (  # noqa: F401
    distance,
    distance_to_score,
    normalise,
    score,
    space_of,
)
from orbivec.operators.knn import find, knn, radial  # noqa: F401
