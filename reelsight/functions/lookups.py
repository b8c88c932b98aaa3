"""Fixed values that results must agree on.

These are data, not logic: the published occupation codes of the ratings
data set, its genre vocabulary, and the blend weights the hybrid model tries.
"""

# Occupation code -> occupation name (codes 0..20).
OCCUPATION_NAMES = {
    0: "other or not specified",
    1: "academic/educator",
    2: "artist",
    3: "clerical/admin",
    4: "college/grad student",
    5: "customer service",
    6: "doctor/health care",
    7: "executive/managerial",
    8: "farmer",
    9: "homemaker",
    10: "K-12 student",
    11: "lawyer",
    12: "programmer",
    13: "retired",
    14: "sales/marketing",
    15: "scientist",
    16: "self-employed",
    17: "technician/engineer",
    18: "tradesman/craftsman",
    19: "unemployed",
    20: "writer",
}

# Fixed value: name given to any code outside the table above.
UNKNOWN_OCCUPATION = "Unknown"

# The genre vocabulary used by the genre matrices.
MOVIE_GENRES = [
    "Action", "Adventure", "Animation", "Children's", "Comedy",
    "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir",
    "Horror", "Musical", "Mystery", "Romance", "Sci-Fi",
    "Thriller", "War",
]

# Fixed values: (w_als, w_lr) pairs the weight sweep tries, and the serving blend.
SWEEP_WEIGHTS = [(0.6, 0.4), (0.9, 0.1), (0.8, 0.2)]
SERVING_WEIGHTS = (0.7, 0.3)

# ALS tuning grid (rank, regParam, maxIter) and the CV fold count.
ALS_RANKS = [5, 10, 20]
ALS_REGS = [0.01, 0.1, 0.5]
ALS_ITERS = [5, 10, 15]
CV_FOLDS = 3

# Content model settings.
TF_FEATURES = 1500
LR_MAX_ITER = 20
LR_REG = 0.1
LR_ELASTIC_NET = 0.8

# Rating scale bounds and the "high rating" band for recommendations.
RATING_MIN = 1.0
RATING_MAX = 5.0
HIGH_BAND = (4.0, 5.0)
