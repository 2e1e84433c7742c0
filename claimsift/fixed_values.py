"""Values that must stay as they are for results to be right.  Fixed values, stated as plain text."""

# The harmonised taxonomy, historical category -> current category.
TAXONOMY = {
    "Credit reporting, credit repair services, or other personal consumer reports": "Credit reporting",
    "Credit reporting": "Credit reporting",
    "Credit card or prepaid card": "Credit card / Prepaid card",
    "Credit card": "Credit card / Prepaid card",
    "Prepaid card": "Credit card / Prepaid card",
    "Bank account or service": "Bank account / Savings",
    "Checking or savings account": "Bank account / Savings",
    "Payday loan, title loan, or personal loan": "Payday & Personal loan",
    "Payday loan": "Payday & Personal loan",
    "Consumer Loan": "Payday & Personal loan",
    "Money transfer, virtual currency, or money service": "Money transfer / Crypto",
    "Money transfers": "Money transfer / Crypto",
    "Virtual currency": "Money transfer / Crypto",
    "Mortgage": "Mortgage",
    "Student loan": "Student loan",
    "Vehicle loan or lease": "Vehicle loan / Lease",
    "Debt collection": "Debt collection",
    "Other financial service": "Other financial service",
}

# The ten tags of the application.  The order matters: the first one is the fallback.
ALLOWED_TAGS = [
    "Credit reporting",
    "Credit card / Prepaid card",
    "Bank account / Savings",
    "Debt collection",
    "Mortgage",
    "Student loan",
    "Payday & Personal loan",
    "Money transfer / Crypto",
    "Vehicle loan / Lease",
    "Other financial service",
]

# Answers used when an external answer names no category or never arrives.
UNKNOWN_CATEGORY = "Autre / Inconnu"
ANSWER_ERROR = "Erreur"
ANSWER_QUOTA = "Erreur (Quota dépassé)"

# The frame put around a claim before it is sent out.
PROMPT_HEAD = 'Réclamation client :\n"""\n'
PROMPT_TAIL = '\n"""\n\nCatégorie :'

# Anonymisation masks, as tokens, for profiling and for training.
MASKS_PROFILE = ["xxxx", "xx", "xxxxxx", "x", "00"]
MASKS_TRAINING = ["xxxx", "xx", "xxxxxx", "x", "00", "xxxxxxxx"]

# A token is a maximal run of two or more letters, digits or underscores of any script.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Texts that a dataframe CSV reader takes for "missing".
NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The characters Python regards as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0 "
    "           "
    "    　"
)

# The characters a browser-side trim() removes.
WEB_WHITESPACE = (
    "\t\n\x0b\x0c\r\x20\xa0 "
    "           "
    "    　﻿"
)

# Numbers of the evaluation protocol.
SEED = 42
TEST_SHARE = 0.2
MIN_SUPPORT = 50
SAMPLE_SIZE = 1000
SEED_TOTAL = 100
SEED_PER_CLASS = 10
PROFILE_SAMPLE = 20000
PROFILE_TOP = 15
LENGTH_CAP = 1000
LENGTH_BINS = 50
DENSITY_POINTS = 200
PROGRESS_EVERY = 25
VOCABULARY_FULL = 50000
VOCABULARY_SAMPLE = 10000
NB_ALPHA = 0.1
LOGISTIC_C = 1.0
LINEAR_ALPHA = 1e-4
MAX_ITERATIONS = 500
MIN_REQUEST_CHARS = 3
MAX_ATTEMPTS = 5
WAIT_STEP_SECONDS = 10
