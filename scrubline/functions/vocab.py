"""Word lists, rates and name hints the cleaning rules are defined by.

All of them are plain data so that a caller can pass an edited copy to the operators.
"""

# ---- Fixed values: they define the results and must not be changed -------------------------

# Text that stands for "no value" in any text column.
PLACEHOLDERS = (
    "", "unknown", "unk", "n/a", "na", "null", "none", "nan", "-", "--", "?",
    "not available", "not specified", "undefined", "no data", "tbd", "to be decided",
    "to be determined", "n\\a", "missing", "tbc", "to be confirmed",
)
# Also "no value", except in columns whose name contains "status".
CONTEXT_PLACEHOLDERS = ("pending", "tba", "to be announced")

NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
)

TRUE_WORDS = ("yes", "y", "true", "1", "t", "1.0")
FALSE_WORDS = ("no", "n", "false", "0", "f", "0.0")

# Names of columns that hold identifiers made of digits, never quantities.
IDENTIFIER_HINTS = (
    "phone", "mobile", "fax", "zip", "postal", "pincode", "pin_code", "ssn", "cnic", "nic",
    "passport", "account_no", "acc_no",
)

# Exchange rates to PKR.
MARKER_RATES = {"usd": 280.0, "eur": 305.0, "gbp": 355.0}
CODE_RATES = {"usd": 280.0, "eur": 305.0, "gbp": 355.0, "pkr": 1.0, "inr": 3.3}
CURRENCY_CODES = ("pkr", "usd", "eur", "gbp", "inr")
AMOUNT_HINTS = ("amount", "price", "fee", "salary", "total", "cost", "balance", "tuition")

GPA_HINTS = ("gpa", "grade_point")
DATE_HINTS = ("date", "dob", "_at", "time")
NOT_CATEGORY_HINTS = ("email", "date", "dob", "_at", "time")
MODE_BLOCKED_HINTS = ("email", "phone", "mobile", "contact", "name", "id", "address")

NON_NEGATIVE_HINTS = (
    "price", "cost", "amount", "revenue", "income", "quantity", "qty", "count", "total",
    "balance", "payment",
)
POSITIVE_HINTS = ("salary", "wage", "stipend", "fee", "tuition")
PERCENT_HINTS = ("pct", "percent", "percentage")
STUDENT_HINTS = ("gpa", "semester_fee", "tuition", "major", "enrollment", "grade_level")

GENDER_WORDS = {
    "m": "Male", "male": "Male",
    "f": "Female", "female": "Female",
    "o": "Other", "other": "Other", "non-binary": "Other", "nonbinary": "Other",
}

STUDY_YEAR_NAMES = {
    "1st year": "1st Year", "1st": "1st Year", "first year": "1st Year", "year 1": "1st Year", "fy": "1st Year", "yr1": "1st Year",
    "2nd year": "2nd Year", "2nd": "2nd Year", "second year": "2nd Year", "year 2": "2nd Year", "sy": "2nd Year", "yr2": "2nd Year",
    "3rd year": "3rd Year", "3rd": "3rd Year", "third year": "3rd Year", "year 3": "3rd Year", "jr": "3rd Year", "yr3": "3rd Year",
    "4th year": "4th Year", "4th": "4th Year", "fourth year": "4th Year", "year 4": "4th Year", "sr": "4th Year", "yr4": "4th Year",
}
# A value of three letters or more that starts one of these words also matches.
STUDY_YEAR_WORDS = {
    "1st Year": ("freshman", "freshmen"),
    "2nd Year": ("sophomore",),
    "3rd Year": ("junior",),
    "4th Year": ("senior",),
}

# Whole values that are acronyms, and single words that are abbreviations.
ACRONYMS = {
    "cs": "computer science", "cse": "computer science", "it": "information technology",
    "ee": "electrical engineering", "me": "mechanical engineering", "ce": "civil engineering",
    "hr": "human resources", "bba": "business administration", "mba": "business administration",
    "ai": "artificial intelligence", "econ": "economics", "ib": "internet banking",
}
ABBREVIATIONS = {
    "bus": "business", "admin": "administration", "elec": "electrical", "engg": "engineering",
    "mgmt": "management", "dept": "department", "info": "information", "tech": "technology",
    "sci": "science", "comm": "commerce", "acct": "accounting", "fin": "finance",
    "mech": "mechanical", "wd": "withdrawal", "net": "internet", "mob": "mobile",
    "txn": "transaction", "pos": "point of sale", "pmt": "payment", "ops": "operations",
    "cust": "customer", "bio": "biology",
}
NEGATION_PREFIXES = ("in", "im", "un", "non", "dis", "ir", "anti")
MIN_PREFIX_LENGTH = 4
MIN_TOKEN_PREFIX_LENGTH = 2

# Tokens a CSV reader takes as missing (the defaults of pandas.read_csv).
CSV_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# ---- end of fixed values -------------------------------------------------------------------
