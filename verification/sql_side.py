"""The same questions as plain SQL, written independently of the Spark operators."""

from __future__ import annotations

from scrubline.functions import vocab
from verification.fixtures import COLUMNS, MIXED, NUMBERS, TEXT, TYPES, sql_view

SQL = {}


def with_views(*views: str, ctes: str = "", body: str) -> str:
    parts = [sql_view(v) for v in views] + ([ctes.strip().rstrip(",")] if ctes else [])
    return "WITH " + ",\n".join(parts) + "\n" + body


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def case_map(x: str, mapping: dict, otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {x} {whens} ELSE {otherwise} END"


# Scalar rules as SQL text

def trim(x):
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), 'nan')"


def missing(x, name=""):
    words = vocab.PLACEHOLDERS if "status" in name else vocab.PLACEHOLDERS + vocab.CONTEXT_PLACEHOLDERS
    return f"CASE WHEN lower(trim({x})) IN ({quoted(words)}) THEN NULL ELSE {x} END"


PERIOD = (r"(/\s*(month|mo|year|yr|annum|week|wk|day)\b|\bper\s+(month|year|week|day|annum)\b"
          r"|\b(monthly|yearly|annually|weekly|daily)\b)")
NOISE = r"(rs\.?|pkr|usd|inr|eur|gbp|\$|€|£|,|\s)"


def without_period(x):
    return f"regexp_replace(lower(trim({x})), '{PERIOD}', '', 'g')"


def rate(x):
    return (f"CASE WHEN regexp_matches(lower({x}), '\\$|\\busd\\b') THEN 280.0 WHEN regexp_matches(lower({x}), '€|\\beur\\b') THEN 305.0 "
            f"WHEN regexp_matches(lower({x}), '£|\\bgbp\\b') THEN 355.0 END")


def number(x, convert=False):
    digits = f"regexp_replace({without_period(x)}, '{NOISE}', '', 'g')"
    words = " ".join(f"WHEN lower(trim({x})) = '{w}' THEN {i}.0" for i, w in enumerate(vocab.NUMBER_WORDS))
    factor = f" * coalesce(CAST({rate(without_period(x))} AS DOUBLE), 1.0)" if convert else ""
    return (f"CASE {words} WHEN regexp_matches({digits}, '^-?\\d+(\\.\\d+)?$') "
            f"THEN try_cast({digits} AS DOUBLE){factor} END")


def date(x):
    return f"try_strptime({x}, ['%Y-%m-%d', '%m/%d/%Y', '%Y/%m/%d'])"


def title_words(x):
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def boolean(x):
    return (f"CASE WHEN lower(trim({x})) IN ({quoted(vocab.TRUE_WORDS)}) THEN true "
            f"WHEN lower(trim({x})) IN ({quoted(vocab.FALSE_WORDS)}) THEN false END")


def gender(x):
    return case_map(f"lower(trim({x}))", vocab.GENDER_WORDS, x)


def study_year(x):
    w = f"trim(regexp_replace(lower({x}), '[._-]', '', 'g'))"
    exact = vocab.STUDY_YEAR_NAMES
    starts = " ".join(
        f"WHEN length({w}) >= 3 AND starts_with('{word}', {w}) THEN '{label}'"
        for label, words in vocab.STUDY_YEAR_WORDS.items() for word in words
    )
    return f"coalesce({case_map(w, exact)}, CASE {starts} END, {x})"


def email(x):
    fixed = f"regexp_replace(replace(trim({x}), ' ', ''), '@@+', '@', 'g')"
    return f"CASE WHEN regexp_matches({fixed}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN {fixed} END"


def gpa(x):
    bare = f"try_cast(replace({x}, '%', '') AS DOUBLE)"
    value = f"(CASE WHEN {x} LIKE '%\\%' ESCAPE '\\' THEN {bare} / 100.0 * 4.0 ELSE {bare} END)"
    return f"CASE WHEN {value} BETWEEN 0 AND 4 THEN {value} END"


def stem(x):
    plain = (f"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower({x}), '\\s*&\\s*', ' and ', 'g'), '-', ' '), "
             f"'[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))")
    words = f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: {case_map('w', vocab.ABBREVIATIONS, 'w')}), ' ')"
    full = f"coalesce({case_map(plain, vocab.ACRONYMS)}, {words})"
    return (f"CASE WHEN {full} LIKE '%ies' THEN left({full}, length({full}) - 3) || 'y' "
            f"WHEN regexp_matches({full}, '(x|ch|sh)es$') THEN left({full}, length({full}) - 2) "
            f"WHEN {full} LIKE '%s' AND {full} NOT LIKE '%ss' THEN left({full}, length({full}) - 1) ELSE {full} END")


def pct(part, whole):
    return f"CASE WHEN {whole} > 0 THEN round_even(CAST({part} AS DOUBLE) / {whole} * 100 * 100, 0) / 100 ELSE 0.0 END"


# Sources and sinks

SQL["read_csv"] = with_views("messy_orders", body=(
    "SELECT order_id, total_price, CAST(fee_amount AS DOUBLE) AS fee_amount, currency, order_date, order_status, priority FROM messy_orders"))
SQL["load_parquet"] = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem"
SQL["union_with_source"] = """
SELECT c_custkey AS party_id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS __source_sheet__ FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'supplier' FROM supplier"""
SQL["write_clean"] = with_views("messy_orders", body=(
    "SELECT CAST(order_id AS VARCHAR) AS order_id, " +
    ", ".join(f"{trim(c)} AS {c}" for c in TEXT["messy_orders"]) + " FROM messy_orders"))
SQL["preview"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"


# Profiling

def missing_rows(rel, view, cols=None):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, {pct(f'(count(*) - count({c}))', 'count(*)')} AS missing_pct, "
        f"'{TYPES[view][c]}' AS dtype FROM {rel}" for c in cols or COLUMNS[view])


def duplicate_row(rel):
    return (f"SELECT CAST(n - u AS BIGINT) AS exact_duplicate_rows, {pct('(n - u)', 'n')} AS exact_duplicate_pct FROM "
            f"(SELECT (SELECT count(*) FROM {rel}) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {rel})) AS u)")


def outlier_rows(rel, cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (abs(({c} - m) / s) > 3) AS outlier_count, "
        f"{pct(f'count(*) FILTER (abs(({c} - m) / s) > 3)', 'count(*)')} AS outlier_pct "
        f"FROM {rel}, (SELECT avg(CAST({c} AS DOUBLE)) AS m, nullif(stddev_pop(CAST({c} AS DOUBLE)), 0) AS s FROM {rel})" for c in cols)


def no_placeholders(view):
    cols = ", ".join(f"{missing(c, c)} AS {c}" if c in TEXT[view] else c for c in COLUMNS[view])
    return f"cleaned AS (SELECT {cols} FROM {view})"


SQL["profile_missing"] = with_views(
    "messy_customer", ctes=no_placeholders("messy_customer"), body=missing_rows("cleaned", "messy_customer"))
SQL["profile_duplicates"] = with_views("messy_customer", body=duplicate_row("messy_customer"))
SQL["profile_outliers"] = with_views("messy_customer", body=outlier_rows("messy_customer", NUMBERS["messy_customer"]))
SQL["profile_outliers_lineitem"] = outlier_rows("lineitem", [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def melted(rel, section, metrics, name='"column"'):
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {name} AS \"column\", '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {rel}" for m in metrics)


SQL["profile_dataset"] = with_views("messy_events", ctes=(
    f"pm AS ({missing_rows('messy_events', 'messy_events')}), pd AS ({duplicate_row('messy_events')}), "
    f"po AS ({outlier_rows('messy_events', NUMBERS['messy_events'])})"), body=" UNION ALL ".join([
        "SELECT 'shape' AS section, NULL AS \"column\", 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM messy_events",
        "SELECT 'shape', NULL, 'columns', CAST(6 AS DOUBLE)",
        melted("pm", "missing", ["missing_count", "missing_pct"]),
        melted("pd", "duplicates", ["exact_duplicate_rows", "exact_duplicate_pct"], "NULL"),
        melted("po", "outliers", ["outlier_count", "outlier_pct"])]))

SQL["cleaning_report"] = with_views("messy_customer", ctes=(
    no_placeholders("messy_customer") + ", after_rows AS (SELECT DISTINCT * FROM cleaned), "
    f"pm AS ({missing_rows('messy_customer', 'messy_customer')}), pd AS ({duplicate_row('messy_customer')}), "
    f"po AS ({outlier_rows('messy_customer', NUMBERS['messy_customer'])}), am AS ({missing_rows('after_rows', 'messy_customer')}), "
    "s AS (SELECT (SELECT count(*) FROM messy_customer) AS rows_before, (SELECT count(*) FROM after_rows) AS rows_after, "
    "(SELECT count(*) FROM messy_customer) - (SELECT count(*) FROM after_rows) AS rows_removed, "
    "(SELECT sum(missing_count) FROM pm) AS missing_before, (SELECT sum(missing_count) FROM am) AS missing_after)"),
    body=" UNION ALL ".join([
        melted("s", "summary", ["rows_before", "rows_after", "rows_removed", "missing_before", "missing_after"], "NULL"),
        melted("pm", "missing_before", ["missing_count", "missing_pct"]),
        melted("pd", "duplicates_before", ["exact_duplicate_rows", "exact_duplicate_pct"], "NULL"),
        melted("po", "outliers_before", ["outlier_count", "outlier_pct"]),
        melted("(SELECT * FROM am WHERE missing_count > 0)", "missing_after", ["missing_count", "missing_pct"])]))


# Text

def project(view, **cols):
    key = COLUMNS[view][0]
    return with_views(view, body=f"SELECT {key}, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {view}")


SQL["trim_whitespace"] = project("messy_customer", **{c: trim(c) for c in ("full_name", "email", "segment")})
SQL["standardize_missing"] = project("messy_customer", **{
    c: missing(c, c) for c in ("email", "gender", "is_active", "account_status", "major", "gpa", "study_year")})
SQL["normalize_text_conversions"] = with_views("messy_customer", body=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NOT NULL AND {missing(trim(c), c)} IS NULL) AS made_missing, "
    f"count(*) FILTER ({missing(trim(c), c)} <> {c}) AS squeezed, count(*) AS n_rows FROM messy_customer" for c in TEXT["messy_customer"]))
SQL["standardize_casing"] = project(
    "messy_customer", full_name=title_words("full_name"), segment=title_words("segment"),
    major="upper(major)", email="lower(email)")
_pr = trim("priority")
SQL["title_case_priority"] = project("messy_orders", priority=f"left({_pr}, 2) || {title_words(f'substr({_pr}, 3)')}")


def detection(view, ctes, test, cols=None):
    """(column, detected) from a test on (n, values of the column)."""
    return with_views(view, ctes=ctes, body=" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce({test(c)}, false) AS detected FROM {'cleaned' if ctes else view}"
        for c in cols or TEXT[view]))


def trimmed_cleaned(view):
    cols = ", ".join(f"{missing(trim(c), c)} AS {c}" if c in TEXT[view] else c for c in COLUMNS[view])
    return f"cleaned AS (SELECT {cols} FROM {view})"


def categorical_test(c):
    if any(h in c for h in vocab.NOT_CATEGORY_HINTS) or "gender" in c or c == "study_year":
        return "count(*) < 0"
    return (f"avg(CASE WHEN {c} LIKE '%@%' THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END) < 0.3 AND count(DISTINCT {c}) BETWEEN 2 AND 200 "
            f"AND count(DISTINCT {c}) / count({c}) <= 0.5 AND avg(length({c})) <= 40")


SQL["detect_categorical"] = detection("messy_customer", trimmed_cleaned("messy_customer"), categorical_test)
SQL["standardize_category_casing"] = project(
    "messy_customer", phone="phone", segment=title_words(trim("segment")),
    account_status=title_words(trim("account_status")),
    major=title_words(trim("major")))
SQL["detect_name_columns"] = with_views("messy_customer", body="SELECT count(*) AS n, 'full_name' AS names FROM messy_customer")
SQL["standardize_name_casing"] = project("messy_customer", full_name=title_words(trim("full_name")))

# Typed columns

SQL["parse_numeric"] = project("messy_orders", plain=number("total_price"), converted=f"round({number('total_price', True)}, 4)")
SQL["detect_currency_rate"] = project("messy_orders", rate=f"CAST({rate('total_price')} AS DOUBLE)")


def numeric_test(c):
    return f"count({number(c)}) / count({c}) >= 0.7"


SQL["detect_numeric_text"] = detection("messy_orders", "", numeric_test)
SQL["detect_numeric_text_shares"] = with_views("messy_customer", ctes=no_placeholders("messy_customer"), body=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, " +
    ("CAST(0 AS BIGINT)" if c == "phone" else f"count({number(c)})") + " AS parsed FROM cleaned"
    for c in TEXT["messy_customer"]))
SQL["clean_numeric_text"] = project("messy_orders", total_price=number("total_price"), fee_amount=number("fee_amount"), priority="priority")
SQL["detect_multi_currency"] = detection("messy_orders", "", lambda c: f"bool_or({rate(c)} IS NOT NULL)")
_code_share = "(SELECT avg(CASE WHEN lower(trim(currency)) IN ('pkr','usd','eur','gbp','inr') THEN 1.0 ELSE 0.0 END) FROM messy_orders WHERE currency IS NOT NULL) >= 0.9"
SQL["detect_currency_pairs"] = with_views("messy_orders", body=(
    f"SELECT * FROM (VALUES ('total_price', 'currency'), ('fee_amount', 'currency')) t(amount, currency) WHERE {_code_share}"))


def converted(rel, amount):
    """Clip inside each currency with ten values or more, then apply its rate."""
    return f"""(SELECT p.*, (CASE WHEN v IS NULL THEN NULL WHEN n >= 10 THEN least(greatest(v, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) ELSE v END)
      * CASE cur WHEN 'usd' THEN 280.0::DOUBLE WHEN 'eur' THEN 305.0::DOUBLE WHEN 'gbp' THEN 355.0::DOUBLE WHEN 'inr' THEN 3.3::DOUBLE ELSE 1.0::DOUBLE END AS pkr
    FROM (SELECT *, lower(trim(currency)) AS cur, {number(amount)} AS v FROM {rel}) p
    LEFT JOIN (SELECT lower(trim(currency)) AS g, count({number(amount)}) AS n, quantile_cont({number(amount)}, 0.25) AS q1,
      quantile_cont({number(amount)}, 0.75) AS q3 FROM {rel} GROUP BY 1) f ON p.cur IS NOT DISTINCT FROM f.g)"""


SQL["convert_currency_by_column"] = with_views("messy_orders", body=(
    f"SELECT order_id, round(pkr, 3) AS total_price FROM {converted('messy_orders', 'total_price')}"))


def date_test(c):
    named = any(h in c for h in vocab.DATE_HINTS)
    look = f"avg(CASE WHEN regexp_matches({c}, '^\\s*\\d{{1,4}}\\s*[-/]\\s*[A-Za-z0-9]{{1,9}}\\s*[-/]\\s*\\d{{1,4}}\\s*$') THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END)"
    parsed = f"count({date(c)}) / count({c})"
    return f"{parsed} >= 0.5" if named else f"{look} >= 0.5 AND {parsed} >= 0.7"


SQL["detect_date_columns"] = detection("messy_orders", "", date_test)
SQL["standardize_dates_auto"] = project("messy_orders", order_date=f"strftime({date('order_date')}, '%Y-%m-%d')")
SQL["standardize_dates"] = with_views("messy_events", body="SELECT event_id, strftime(event_ts, '%Y-%m-%d') AS event_ts FROM messy_events")


def any_date(x):
    """The moment in any of the forms of ``mixed_dates``."""
    forms = ("%Y-%m-%d", "%m/%d/%Y", "%Y/%m/%d", "%b %d, %Y", "%d %B %Y", "%d-%b-%Y", "%Y%m%d", "%a, %d %b %Y", "%B %d, %Y",
             "%m.%d.%Y", "%Y-%m-%dT%H:%M:%SZ", "%I:%M %p %m/%d/%Y", "%B %Y")
    return f"try_strptime(replace({x}, 'th, ', ', '), [{quoted(forms)}])"


SQL["detect_date_columns_mixed"] = with_views("mixed_dates", body=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({any_date(c)}) / count({c}) >= 0.5 AS detected FROM mixed_dates" for c in TEXT["mixed_dates"]))
SQL["standardize_dates_auto_mixed"] = with_views("mixed_dates", body=(
    f"SELECT order_id, strftime({any_date('order_date')}, '%Y-%m-%d %H:%M:%S') AS order_date, note FROM mixed_dates"))
SQL["standardize_dates_mixed"] = with_views("mixed_dates", body="SELECT order_id, " + ", ".join(
    f"strftime({any_date(c)}, '%Y-%m-%d') AS {c}" for c in TEXT["mixed_dates"]) + " FROM mixed_dates")
SQL["cast_columns"] = with_views("messy_orders", body=(
    "SELECT CAST(order_id AS VARCHAR) AS order_id, total_price, CAST(fee_amount AS DOUBLE) AS fee_amount FROM messy_orders"))
_bool_words = quoted(vocab.TRUE_WORDS + vocab.FALSE_WORDS)
SQL["detect_boolean"] = detection("messy_customer", no_placeholders("messy_customer"), lambda c: "count(*) < 0" if c == "gender" else (
    f"avg(CASE WHEN lower(trim({c})) IN ({_bool_words}) THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END) >= 0.9"))
SQL["standardize_boolean"] = project("messy_customer", is_active=boolean("is_active"))
SQL["standardize_gender"] = project("messy_customer", gender=gender("gender"))
SQL["standardize_year_of_study"] = project("messy_customer", study_year=study_year("study_year"))
SQL["detect_email"] = with_views("messy_customer", body=" UNION ALL ".join(
    f"SELECT '{'contact' if c == 'email' else c}' AS \"column\", avg(CASE WHEN {c} LIKE '%@%' THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END) >= 0.5 AS detected FROM messy_customer"
    for c in TEXT["messy_customer"]))
SQL["clean_email"] = project("messy_customer", email=email("email"))
SQL["standardize_gpa"] = project("messy_customer", gpa=f"round({gpa('gpa')}, 4)")
SQL["drop_id_like"] = ("SELECT round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, "
    "round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax, "
    "'l_orderkey,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax' AS kept FROM lineitem")

BOUNDS = {
    "age": "CASE WHEN age > 14 AND age <= 120 THEN age END",
    "salary": "CASE WHEN salary > 0 THEN salary END",
    "attendance_pct": "CASE WHEN attendance_pct BETWEEN 0 AND 100 THEN attendance_pct END",
    "balance": "CASE WHEN balance >= 0 THEN balance END",
}
SQL["enforce_domain_bounds"] = project("messy_customer", **BOUNDS)

_t = {c: trim(c) for c in TEXT["messy_orders"]}


def typed_orders(rel="messy_orders"):
    """Both amounts converted, dates and casing, on trimmed text; needs CTEs t and f."""
    return f"""t AS (SELECT order_id, {", ".join(f"{missing(e, c)} AS {c}" for c, e in _t.items())} FROM {rel}),
    a AS (SELECT order_id, pkr AS total FROM {converted('t', 'total_price')}),
    f AS (SELECT order_id, pkr AS fee FROM {converted('t', 'fee_amount')}),
    typed AS (SELECT t.order_id, CASE WHEN total >= 0 THEN total END AS total_price, CASE WHEN fee > 0 THEN fee END AS fee_amount,
      {title_words('currency')} AS currency, strftime({date('order_date')}, '%Y-%m-%d') AS order_date, {title_words('order_status')} AS order_status,
      left(priority, 2) || {title_words('substr(priority, 3)')} AS priority FROM t JOIN a USING (order_id) JOIN f USING (order_id))"""


SQL["run_type_cleaning"] = with_views("messy_orders", ctes=typed_orders(), body=(
    "SELECT order_id, round(total_price, 3) AS total_price, round(fee_amount, 3) AS fee_amount, currency, order_date, order_status, priority, "
    "'currency,fee_amount,total_price' AS protected FROM typed"))

# Rows and statistics

SQL["remove_exact_duplicates"] = with_views("messy_customer", body=(
    "SELECT customer_id, full_name, balance FROM (SELECT DISTINCT * FROM messy_customer)"))


def fence(c, rel):
    q = f"(SELECT quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) FROM {rel})"
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest(CAST({c} AS DOUBLE), {q}[1] - 1.5 * ({q}[2] - {q}[1])), {q}[2] + 1.5 * ({q}[2] - {q}[1])) END"


SQL["cap_outliers_iqr"] = with_views("messy_events", body=(
    f"SELECT event_id, round({fence('amount', 'messy_events')}, 4) AS amount FROM messy_events"))
SQL["cap_outliers_lineitem"] = "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({fence(c, 'lineitem')}, 4) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem"

_c = {c: missing(trim(c), c) for c in TEXT["messy_customer"]}
RULED_CUSTOMER = f"""cleaned AS (SELECT customer_id, {", ".join(f"{e} AS {c}" for c, e in _c.items())}, age, salary, attendance_pct, balance FROM messy_customer),
typed AS (SELECT DISTINCT customer_id, {title_words('full_name')} AS full_name, {email('email')} AS email, {gender('gender')} AS gender,
  {boolean('is_active')} AS is_active, {title_words('segment')} AS segment, {title_words('account_status')} AS account_status, {title_words('major')} AS major,
  phone, {gpa('gpa')} AS gpa, {study_year('study_year')} AS study_year, {", ".join(f"{e} AS {c}" for c, e in BOUNDS.items())} FROM cleaned),
ruled AS (SELECT customer_id, full_name, email, gender, is_active, segment, account_status, major, phone, study_year,
  {", ".join(f"{fence(c, 'typed')} AS {c}" for c in ("gpa", "age", "salary", "attendance_pct", "balance"))} FROM typed)"""
SQL["run_rule_cleaning"] = with_views("messy_customer", ctes=RULED_CUSTOMER, body=(
    "SELECT customer_id, full_name, email, gender, is_active, segment, account_status, major, phone, study_year, "
    "round(gpa, 4) AS gpa, round(age, 4) AS age, round(salary, 4) AS salary, round(attendance_pct, 4) AS attendance_pct, round(balance, 4) AS balance FROM ruled"))


# Learned layer

def knn(rel, cols, k=5):
    """CTEs ending in ``filled``: rid plus the filled columns."""
    p = len(cols)
    shared = " + ".join(f"(n.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in cols)
    squares = " + ".join(f"coalesce((n.{c} - d.{c}) * (n.{c} - d.{c}), 0.0)" for c in cols)
    ctes = [
        f"r AS (SELECT row_number() OVER () AS rid, * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)}) FROM {rel})",
        f"need AS (SELECT * FROM r WHERE ({' OR '.join(f'{c} IS NULL' for c in cols)}))",
        f"pairs AS (SELECT n.rid, {', '.join(f'n.{c} IS NULL AS need_{c}, d.{c} AS {c}' for c in cols)}, "
        f"CASE WHEN {shared} > 0 THEN sqrt({p}.0::DOUBLE / ({shared}) * ({squares})) END AS dist FROM need n, r d)",
    ]
    fills = []
    for c in cols:
        ctes.append(
            f"k_{c} AS (SELECT rid, avg({c}) AS v FROM (SELECT rid, {c}, row_number() OVER (PARTITION BY rid ORDER BY dist, {c}) AS place "
            f"FROM pairs WHERE need_{c} AND {c} IS NOT NULL AND dist IS NOT NULL) WHERE place <= {k} GROUP BY rid)")
        ctes.append(
            f"s_{c} AS (SELECT avg({c}) AS spare, min({c}) AS low, max({c}) AS high, "
            f"count(*) FILTER ({c} - floor({c}) <= 1e-8) / count({c}) >= 0.98 AS whole FROM r)")
        value = f"coalesce(r.{c}, k_{c}.v, s_{c}.spare)"
        fills.append(f"CASE WHEN s_{c}.whole THEN least(greatest(round_even({value}, 0), s_{c}.low), s_{c}.high) ELSE {value} END AS {c}")
    joins = " ".join(f"LEFT JOIN k_{c} ON k_{c}.rid = r.rid CROSS JOIN s_{c}" for c in cols)
    ctes.append(f"filled AS (SELECT r.* REPLACE ({', '.join(fills)}) FROM r {joins})")
    return ",\n".join(ctes)


SQL["impute_knn"] = with_views("messy_customer", ctes=knn("messy_customer", ["age", "salary"]), body=(
    "SELECT customer_id, round(age, 4) AS age, round(salary, 4) AS salary FROM filled"))
SQL["impute_knn_mixed_gaps"] = with_views("mixed_gaps", ctes=knn("mixed_gaps", MIXED), body=(
    "SELECT customer_id, " + ", ".join(f"round({c}, 4) AS {c}" for c in MIXED) + " FROM filled"))
SQL["impute_median"] = with_views("messy_events", body=(
    "SELECT event_id, round(coalesce(amount, (SELECT median(amount) FROM messy_events)), 4) AS amount FROM messy_events"))
SQL["round_integer_like"] = with_views("messy_customer", body=(
    "SELECT customer_id, CASE WHEN salary IS NOT NULL THEN least(greatest(round_even(salary / 8, 0), 100.0::DOUBLE), 8000.0::DOUBLE) END AS x FROM messy_customer"))


def mode(c):
    return f"coalesce({c}, (SELECT {c} FROM cleaned WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))"


SQL["impute_mode"] = with_views("messy_customer", ctes=no_placeholders("messy_customer"), body=(
    f"SELECT customer_id, {mode('major')} AS major, {mode('study_year')} AS study_year, {mode('gender')} AS gender, email FROM cleaned"))
SQL["expand_and_stem"] = project("messy_customer", **{c: stem(c) for c in ("segment", "major", "full_name", "email")})
SQL["pair_tests"] = project(
    "messy_customer",
    opposite="lower(account_status) IN (" + quoted(p + "active" for p in vocab.NEGATION_PREFIXES) + ")",
    prefix="(starts_with(lower(trim(segment)), 'building') OR starts_with('building', lower(trim(segment)))) AND length(trim(segment)) >= 4",
    token_prefix_3="false", token_prefix_2="lower(major) = 'computer science'")


def lcs(pairs):
    """CTE ``lcs``: a, b, n = length of the longest common subsequence, row by row of the table."""
    cells = ("list_transform(range(1, CAST(length(b) AS BIGINT) + 1), lambda j: greatest(cells[j + 1], "
             "CASE WHEN substr(b, j, 1) = substr(a, i + 1, 1) THEN cells[j] + 1 ELSE 0 END))")
    return f"""RECURSIVE_LCS AS (SELECT a, b, CAST(0 AS BIGINT) AS i, list_transform(range(0, CAST(length(b) AS BIGINT) + 1), lambda j: CAST(0 AS BIGINT)) AS cells FROM {pairs}
    UNION ALL SELECT a, b, i + 1, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, CAST(length(b) AS BIGINT) + 1), lambda j: list_max(steps[1:j])))
    FROM (SELECT a, b, i, {cells} AS steps FROM RECURSIVE_LCS WHERE i < length(a))),
    lcs AS (SELECT a, b, list_max(cells) AS n FROM RECURSIVE_LCS WHERE i = length(a))"""


SQL["indel_ratio"] = "WITH RECURSIVE todo AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part), " + lcs("todo") + """
SELECT p_partkey, round(CAST(200.0 AS DOUBLE) * n / (length(a) + length(b)), 4) AS ratio FROM part JOIN lcs ON a = p_name AND b = lower(p_type)"""

_starts = "(starts_with({a}, {b}) OR starts_with({b}, {a}))"
ALIKE = f"""stems AS (SELECT DISTINCT {stem('p_name')} AS s FROM part),
    todo AS (SELECT x.s AS a, y.s AS b FROM stems x, stems y WHERE x.s < y.s), {lcs('todo')},
    alike AS (SELECT a, b, CAST(200.0 AS DOUBLE) * n / (length(a) + length(b)) AS ratio FROM lcs
      WHERE (200.0 * n / (length(a) + length(b)) >= 85 OR ({_starts.format(a='a', b='b')} AND least(length(a), length(b)) >= 4)
        OR replace(a, ' ', '') = replace(b, ' ', '')
        OR ({_starts.format(a="split_part(a, ' ', 1)", b="split_part(b, ' ', 1)")} AND {_starts.format(a="split_part(a, ' ', 2)", b="split_part(b, ' ', 2)")}))
        AND NOT ({" OR ".join(f"a = '{p}' || b OR b = '{p}' || a" for p in vocab.NEGATION_PREFIXES)}))"""
SQL["similar_pairs"] = f"WITH RECURSIVE {ALIKE} SELECT a AS stem_a, b AS stem_b, round(ratio, 4) AS ratio FROM alike"
SQL["fuzzy_standardize_parts"] = f"""WITH RECURSIVE {ALIKE},
    links AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike UNION SELECT s, s FROM stems),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    roots AS (SELECT a AS s, min(b) AS root FROM reach GROUP BY 1),
    named AS (SELECT p_name, root, count(*) AS n FROM part JOIN roots ON s = {stem('p_name')} GROUP BY ALL),
    best AS (SELECT DISTINCT ON (root) root, p_name AS canonical FROM named ORDER BY root, n DESC, p_name)
    SELECT p_partkey, canonical AS p_name FROM part JOIN named USING (p_name) JOIN best USING (root)"""


def spelled(c, rel, group=None):
    """CTE <c>_best: the most frequent spelling of each stem."""
    g = group or stem(c)
    return (f"{c}_best AS (SELECT DISTINCT ON (g) g, {c} AS best FROM (SELECT {c}, {g} AS g, count(*) AS n FROM {rel} WHERE {c} IS NOT NULL GROUP BY ALL) "
            f"ORDER BY g, n DESC, {c})")


SQL["fuzzy_standardize"] = with_views("messy_events", ctes=spelled("event_type", "messy_events"), body=(
    f"SELECT event_id, best AS event_type FROM messy_events JOIN event_type_best ON g = {stem('event_type')}"))
SQL["run_ml_cleaning"] = with_views("messy_events", ctes=spelled("event_type", "messy_events"), body=(
    f"SELECT event_id, best AS event_type, round(coalesce(amount, (SELECT CASE WHEN count(*) > 20000 THEN median(amount) ELSE avg(amount) END FROM messy_events)), 4) AS amount "
    f"FROM messy_events JOIN event_type_best ON g = {stem('event_type')}"))

# Mapping layer

SQL["distinct_value_batches"] = with_views("messy_customer", body="""
SELECT batch, string_agg(full_name, '|' ORDER BY full_name) AS members FROM (
  SELECT full_name, CAST(floor((row_number() OVER (ORDER BY full_name) - 1) / 50) AS BIGINT) AS batch FROM (SELECT DISTINCT full_name FROM messy_customer))
GROUP BY batch""")
SQL["apply_value_mapping"] = project("messy_customer", segment="CASE WHEN segment LIKE '%S' THEN segment ELSE upper(trim(segment)) END")
SQL["standardize_with_mapper"] = with_views("messy_customer", ctes="""
placed AS (SELECT segment, floor((row_number() OVER (ORDER BY segment) - 1) / 2) AS batch FROM (SELECT DISTINCT segment FROM messy_customer)),
bad AS (SELECT batch FROM placed WHERE segment = 'BUILDING')""", body="""
SELECT customer_id, CASE WHEN batch IN (SELECT batch FROM bad) THEN segment ELSE lower(trim(segment)) END AS segment, 'partial' AS status
FROM messy_customer JOIN placed USING (segment)""")
SQL["suggest_missing"] = with_views("messy_events", body="""
SELECT event_id, CASE WHEN amount IS NULL AND NOT starts_with(lower(trim(event_type)), 'error') THEN user_id / 2.0::DOUBLE ELSE amount END AS amount
FROM messy_events""")
SQL["run_mapping"] = project("messy_customer", account_status="lower(account_status)", major="lower(major)")

# Everything together

_numbers = ["gpa", "age", "salary", "attendance_pct", "balance"]
_plain = "customer_id, full_name, email, gender, is_active, phone, study_year"
CLEANED_CUSTOMER = RULED_CUSTOMER + ",\n" + knn("ruled", _numbers) + ",\n" + ",\n".join(
    spelled(c, "ruled") for c in ("segment", "account_status", "major")) + f""",
finished AS (SELECT {_plain}, a.best AS segment, b.best AS account_status, c.best AS major, {", ".join(_numbers)} FROM filled
  LEFT JOIN segment_best a ON a.g = {stem('segment')} LEFT JOIN account_status_best b ON b.g = {stem('account_status')}
  LEFT JOIN major_best c ON c.g = {stem('major')})"""
SQL["clean"] = with_views("messy_customer", ctes=CLEANED_CUSTOMER, body=(
    f"SELECT {_plain}, segment, account_status, major, {', '.join(f'round({c}, 4) AS {c}' for c in _numbers)} FROM finished"))
SQL["clean_report"] = with_views("messy_customer", ctes=CLEANED_CUSTOMER, body=(
    "SELECT metric, CAST(value AS DOUBLE) AS value FROM (SELECT 'rows_before' AS metric, count(*) AS value FROM messy_customer "
    "UNION ALL SELECT 'rows_after', count(*) FROM finished "
    "UNION ALL SELECT 'rows_removed', (SELECT count(*) FROM messy_customer) - count(*) FROM finished "
    "UNION ALL SELECT 'missing_before', " + " + ".join(f"count(*) - count({c})" for c in COLUMNS["messy_customer"]) + " FROM messy_customer "
    "UNION ALL SELECT 'missing_after', " + " + ".join(f"count(*) - count({c})" for c in COLUMNS["messy_customer"]) + " FROM finished)"))
SQL["apply_cleaning_plan"] = with_views("messy_orders", ctes=typed_orders() + ", spare AS (SELECT CASE WHEN count(*) > 20000 THEN median(total_price) ELSE avg(total_price) END AS v FROM typed)", body=(
    "SELECT order_id, round(coalesce(total_price, v), 3) AS total_price, round(fee_amount, 3) AS fee_amount, currency, order_date, order_status, priority FROM typed, spare"))
SQL["saved_cleaning_plan"] = SQL["apply_cleaning_plan"]
SQL["isolation_forest_properties"] = with_views("messy_events", body=(
    "SELECT count(*) AS n_rows, count(amount) AS n_complete, 0::BIGINT AS flagged_incomplete, 0::BIGINT AS unknown, "
    "true AS at_most_the_share, true AS not_far_below, true AS furthest_flagged FROM messy_events"))
SQL["load_files"] = """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS folder, o_orderkey, o_totalprice,
  nullif(o_orderstatus, 'F') AS o_orderstatus
FROM orders"""
