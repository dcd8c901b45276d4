"""The same questions in plain SQL, for an independent engine over the same tables.

The SQL is written the simple way: global windows, joins on everything. It shares nothing
with the Spark plans but the definition of the result.
"""

from ebbline import schema

ID, LABEL = schema.ID, schema.LABEL
ORACLES: dict[str, str] = {}


def six_places(expression: str) -> str:
    return f"floor(CAST({expression} AS DOUBLE) * 1000000 + 0.5) / 1000000"


def r(expression: str, name: str) -> str:
    return f"{six_places(expression)} AS {name}"


ACCOUNTS = """
spend AS (
  SELECT o_custkey, avg(o_totalprice) AS avg_price FROM orders GROUP BY o_custkey
), hashed AS (
  SELECT md5(CAST(c_custkey AS VARCHAR)) AS m, c_custkey,
         round(18.25 + coalesce(avg_price, 0.0) / 5000.0, 2) AS monthly
  FROM customer LEFT JOIN spend ON o_custkey = c_custkey
), digits AS (
  SELECT c_custkey, m, monthly,
         ((instr('0123456789abcdef', substr(m, 1, 1)) - 1) * 16
           + instr('0123456789abcdef', substr(m, 2, 1)) - 1) % 73 AS tenure,
         CASE WHEN substr(m, 3, 1) < '8' THEN 'Female' ELSE 'Male' END AS gender,
         CASE WHEN substr(m, 4, 1) < '3' THEN 1 ELSE 0 END AS senior,
         CASE WHEN substr(m, 5, 1) < '8' THEN 'Yes' ELSE 'No' END AS partner,
         CASE WHEN substr(m, 6, 1) < '5' THEN 'Yes' ELSE 'No' END AS dependents,
         CASE WHEN substr(m, 7, 1) < 'e' THEN 'Yes' ELSE 'No' END AS phone,
         CASE WHEN substr(m, 8, 1) < '7' THEN 'Fiber optic'
              WHEN substr(m, 8, 1) < 'c' THEN 'DSL' ELSE 'No' END AS internet,
         CASE WHEN substr(m, 9, 1) < '9' THEN 'Month-to-month'
              WHEN substr(m, 9, 1) < 'c' THEN 'One year' ELSE 'Two year' END AS contract,
         CASE WHEN substr(m, 10, 1) < '9' THEN 'Yes' ELSE 'No' END AS paperless,
         CASE WHEN substr(m, 11, 1) < '5' THEN 'Electronic check'
              WHEN substr(m, 11, 1) < '9' THEN 'Mailed check'
              WHEN substr(m, 11, 1) < 'd' THEN 'Bank transfer (automatic)'
              ELSE 'Credit card (automatic)' END AS payment,
         instr('0123456789abcdef', substr(m, 20, 1)) - 1 AS noise
  FROM hashed
), accounts AS (
SELECT CAST(c_custkey AS VARCHAR) AS "customerID", gender, senior AS "SeniorCitizen",
  partner AS "Partner", dependents AS "Dependents", CAST(tenure AS INT) AS tenure,
  phone AS "PhoneService",
  CASE WHEN phone = 'No' THEN 'No phone service' WHEN substr(m, 12, 1) < '7' THEN 'Yes' ELSE 'No' END AS "MultipleLines",
  internet AS "InternetService",
  CASE WHEN internet = 'No' THEN 'No internet service' WHEN substr(m, 13, 1) < '6' THEN 'Yes' ELSE 'No' END AS "OnlineSecurity",
  CASE WHEN internet = 'No' THEN 'No internet service' WHEN substr(m, 14, 1) < '7' THEN 'Yes' ELSE 'No' END AS "OnlineBackup",
  CASE WHEN internet = 'No' THEN 'No internet service' WHEN substr(m, 15, 1) < '7' THEN 'Yes' ELSE 'No' END AS "DeviceProtection",
  CASE WHEN internet = 'No' THEN 'No internet service' WHEN substr(m, 16, 1) < '6' THEN 'Yes' ELSE 'No' END AS "TechSupport",
  CASE WHEN internet = 'No' THEN 'No internet service' WHEN substr(m, 17, 1) < '8' THEN 'Yes' ELSE 'No' END AS "StreamingTV",
  CASE WHEN internet = 'No' THEN 'No internet service' WHEN substr(m, 18, 1) < '8' THEN 'Yes' ELSE 'No' END AS "StreamingMovies",
  contract AS "Contract", paperless AS "PaperlessBilling", payment AS "PaymentMethod",
  monthly AS "MonthlyCharges",
  CASE WHEN tenure = 0 THEN ' ' ELSE CAST(round(tenure * monthly, 2) AS VARCHAR) END AS "TotalCharges",
  CASE WHEN noise < 1 + CASE WHEN contract = 'Month-to-month' THEN 3 ELSE 0 END
                      + CASE WHEN internet = 'Fiber optic' THEN 2 ELSE 0 END
                      + CASE WHEN tenure < 12 THEN 3 ELSE 0 END
                      + CASE WHEN payment = 'Electronic check' THEN 1 ELSE 0 END
                      + senior
       THEN 'Yes' ELSE 'No' END AS "Churn"
FROM digits
)"""

# Numeric charges; blanks stay null (num), become 0 (zero) or the median (mid).
NUMERIC = """, num AS (SELECT * REPLACE (TRY_CAST("TotalCharges" AS DOUBLE) AS "TotalCharges") FROM accounts)"""
ZERO = NUMERIC + """, zero AS (SELECT * REPLACE (coalesce("TotalCharges", 0.0) AS "TotalCharges") FROM num)"""
MID = NUMERIC + """, mid AS (
  SELECT * REPLACE (coalesce("TotalCharges", (SELECT median("TotalCharges") FROM num)) AS "TotalCharges") FROM num)"""

SCORES = """, scores AS (
  SELECT "customerID" AS id, 'card_a' AS model, CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS label,
    round((CASE WHEN "Contract" = 'Month-to-month' THEN 3 ELSE 0 END + CASE WHEN tenure < 12 THEN 3 ELSE 0 END
      + "MonthlyCharges" / CAST(200 AS DOUBLE)) / CAST(8 AS DOUBLE), 2) AS score, * FROM accounts
  UNION ALL
  SELECT "customerID" AS id, 'card_b' AS model, CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS label,
    round(CAST(CASE WHEN "Contract" = 'Month-to-month' THEN 3 ELSE 0 END
      + CASE WHEN "InternetService" = 'Fiber optic' THEN 2 ELSE 0 END + CASE WHEN tenure < 12 THEN 3 ELSE 0 END
      + CASE WHEN "PaymentMethod" = 'Electronic check' THEN 1 ELSE 0 END + "SeniorCitizen" AS DOUBLE)
      / CAST(10 AS DOUBLE), 2) AS score, * FROM accounts
), scored AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scores)"""

LINES = """WITH scored AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS id,
    l_linestatus AS model, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    round(l_discount * 5 + l_tax, 2) AS score,
    CASE WHEN round(l_discount * 5 + l_tax, 2) >= 0.3 THEN 1 ELSE 0 END AS prediction
  FROM lineitem)"""

TRIALS = """WITH trials AS (
  SELECT o_orderstatus AS study, o_orderkey AS trial,
    CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / CAST(500000 AS DOUBLE), 3) END AS score
  FROM orders)"""


def split_cte(source: str, label: str, key: str, size: float, seed: int, name: str = "parted") -> str:
    return f""", {name} AS (
  SELECT * EXCLUDE (rn, n), CASE WHEN rn <= floor(n * CAST({size} AS DOUBLE) + 0.5) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, count(*) OVER (PARTITION BY {label}) AS n,
          row_number() OVER (PARTITION BY {label}
            ORDER BY md5(concat(CAST({key} AS VARCHAR), ':{seed}')), {key}) AS rn FROM {source}))"""


def fold_cte(source: str, k: int, name: str = "folded") -> str:
    return f""", {name} AS (
  SELECT * EXCLUDE (rn, n), CAST(((rn - 1) * {k}) // n AS INT) AS fold
  FROM (SELECT *, count(*) OVER (PARTITION BY "Churn") AS n,
          row_number() OVER (PARTITION BY "Churn"
            ORDER BY md5(concat("customerID", ':42')), "customerID") AS rn FROM {source}))"""


def acc(name: str, body: str, extra: str = "") -> None:
    ORACLES[name] = f"WITH {ACCOUNTS.strip()}{extra}\n{body}"


def raw(name: str, body: str) -> None:
    ORACLES[name] = body


ALL = ", ".join(f'"{c}"' for c in schema.ACCOUNT_COLUMNS)


def every(replaced: dict[str, str], source: str) -> str:
    """All account columns, some computed."""
    cells = [f'{replaced[c]} AS "{c}"' if c in replaced else f'"{c}"' for c in schema.ACCOUNT_COLUMNS]
    return f"SELECT {', '.join(cells)} FROM {source}"


MONTHLY = six_places('"MonthlyCharges"')
TOTAL = six_places('"TotalCharges"')

# Sources and sinks

acc("read_accounts_csv", every({"MonthlyCharges": MONTHLY}, "accounts"))
acc("read_accounts_orc", every({"MonthlyCharges": MONTHLY}, "accounts"))
acc(
    "prepared_test_rows",
    f'SELECT "{ID}", "{LABEL}", tenure, split FROM parted WHERE split = \'test\'',
    split_cte("accounts", f'"{LABEL}"', f'"{ID}"', 0.2, 42),
)
RANKED = f"""{TRIALS}
SELECT study, trial, {six_places("score")} AS score,
  CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY study ORDER BY score DESC NULLS LAST) END AS rank
FROM trials"""
raw("search_results_csv", RANKED)
raw("rank_trials", RANKED)

# Profiling and cleaning

TYPES = {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}
acc(
    "table_profile",
    " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS column_name, '{TYPES.get(c, "string")}' AS data_type,
        count(*) AS n_rows, 21 AS n_columns, count(*) FILTER (WHERE "{c}" IS NULL) AS n_missing FROM accounts"""
        for i, c in enumerate(schema.ACCOUNT_COLUMNS)
    ),
)
acc(
    "table_preview",
    every({"MonthlyCharges": MONTHLY}, f'(SELECT * FROM accounts ORDER BY "{ID}" LIMIT 5)'),
)


def described_number(column: str, source: str) -> str:
    x = f'CAST("{column}" AS DOUBLE)'
    return f"""SELECT '{column}' AS column_name, count({x}) AS n_values, CAST(NULL AS BIGINT) AS n_distinct,
      CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS top_count, {r(f"avg({x})", "mean")},
      {r(f"stddev_samp({x})", "std")}, {r(f"min({x})", "min")}, {r(f"quantile_cont({x}, 0.25)", "p25")},
      {r(f"quantile_cont({x}, 0.5)", "p50")}, {r(f"quantile_cont({x}, 0.75)", "p75")}, {r(f"max({x})", "max")}
      FROM {source}"""


def described_text(column: str, source: str) -> str:
    none = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    return f"""SELECT '{column}' AS column_name, CAST(sum(c) AS BIGINT) AS n_values, count(*) AS n_distinct,
      (SELECT CAST("{column}" AS VARCHAR) FROM {source} WHERE "{column}" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
      max(c) AS top_count, {none}
      FROM (SELECT "{column}" AS v, count(*) AS c FROM {source} WHERE "{column}" IS NOT NULL GROUP BY 1)"""


NUMBERS = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]
acc(
    "describe_all",
    " UNION ALL ".join(
        described_number(c, "num") if c in NUMBERS else described_text(c, "num") for c in schema.ACCOUNT_COLUMNS
    ),
    NUMERIC,
)
raw(
    "describe_lineitem",
    " UNION ALL ".join(
        [described_number(c, "lineitem") for c in LINE_NUMBERS]
        + [described_text(c, "lineitem") for c in ("l_returnflag", "l_linestatus", "l_shipdate")]
    ),
)
raw(
    "describe_events",
    " UNION ALL ".join(
        [described_number(c, "events") for c in ("event_id", "user_id", "value")]
        + [described_text(c, "events") for c in ("ts", "event_type", "props")]
    ),
)
acc(
    "missing_report",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE "{c}" IS NULL) AS n_missing,
        round(count(*) FILTER (WHERE "{c}" IS NULL) * CAST(100 AS DOUBLE) / count(*), 2) AS pct_missing
        FROM num"""
        for c in schema.ACCOUNT_COLUMNS
    )
    + ") WHERE n_missing > 0",
    NUMERIC,
)
for name, column, source in (
    ("label_distribution", LABEL, "accounts"),
    ("label_distribution_lineitem", "l_returnflag", "lineitem"),
):
    body = f"""SELECT "{column}" AS label, count(*) AS n,
      {r(f'count(*) / CAST((SELECT count("{column}") FROM {source}) AS DOUBLE)', "share")}
      FROM {source} WHERE "{column}" IS NOT NULL GROUP BY 1"""
    acc(name, body) if source == "accounts" else raw(name, body)
acc(
    "drop_identifier",
    f'SELECT * EXCLUDE ("{ID}") FROM (' + every({"MonthlyCharges": MONTHLY}, "accounts") + ")",
)
for name, extra, source in (
    ("coerce_numeric", NUMERIC, "num"),
    ("impute_median", MID, "mid"),
    ("impute_constant", ZERO, "zero"),
):
    acc(name, f'SELECT "{ID}", {TOTAL} AS "TotalCharges" FROM {source}', extra)
acc(
    "missing_rows",
    f"""SELECT "{ID}", tenure, {MONTHLY} AS "MonthlyCharges", "TotalCharges", "{LABEL}"
    FROM num WHERE "TotalCharges" IS NULL""",
    NUMERIC,
)
acc(
    "distinct_values",
    " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS column_name, \"{c}\" AS value FROM accounts" for c in schema.CATEGORY_COLUMNS
    ),
)
acc(
    "remaining_text_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(\"{c}\") AS n_values FROM accounts"
        for c in [ID, *schema.CATEGORY_COLUMNS]
    ),
)
acc("clean", every({"MonthlyCharges": MONTHLY, "TotalCharges": TOTAL}, "mid"), MID)

# Encoding and features


def yes(column: str) -> str:
    return f"CASE WHEN \"{column}\" = 'Yes' THEN 1 ELSE 0 END"


acc("encode_label", f'SELECT "{ID}", {yes(LABEL)} AS "{LABEL}" FROM accounts')
acc(
    "encode_label_strict",
    f"""SELECT "{ID}", CASE "{LABEL}" WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS "{LABEL}" FROM accounts""",
)
acc(
    "encode_binary",
    f'SELECT "{ID}", "SeniorCitizen", '
    + ", ".join(f'{yes(c)} AS "{c}"' for c in schema.BINARY_COLUMNS)
    + " FROM accounts",
)


def codes(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, "{c}" AS value, CAST(row_number() OVER (ORDER BY "{c}") - 1 AS INT) AS code
        FROM (SELECT DISTINCT "{c}" FROM {source})"""
        for c in columns
    )


def code_of(column: str, source: str = "accounts") -> str:
    """The code by counting smaller values, one scalar subquery per known value."""
    return f'coalesce((SELECT code FROM codes WHERE column_name = \'{column}\' AND value = src."{column}"), 0)'


CODES = f""", codes AS ({codes(schema.CATEGORY_COLUMNS, "accounts")})"""
acc("fit_encoders", codes(schema.CATEGORY_COLUMNS, "accounts"))
acc(
    "apply_encoders",
    f'SELECT "{ID}", '
    + ", ".join(f'{code_of(c)} AS "{c}"' for c in schema.CATEGORY_COLUMNS)
    + " FROM accounts AS src",
    CODES,
)
acc(
    "apply_encoders_lenient",
    f'SELECT "{ID}", {code_of("Contract")} AS "Contract", {code_of("gender")} AS gender FROM accounts AS src',
    f""", known AS (SELECT * FROM accounts WHERE "Contract" <> 'Month-to-month'),
    codes AS ({codes(["Contract", "gender"], "known")})""",
)
raw("encoder_table_parts", codes(["p_type", "p_brand", "p_name"], "part"))
raw(
    "encode_customer_names",
    f"""WITH codes AS ({codes(["c_name", "c_mktsegment"], "customer")})
    SELECT c_custkey, {code_of("c_name")} AS c_name, {code_of("c_mktsegment")} AS c_mktsegment FROM customer AS src""",
)
acc(
    "charges_per_month",
    f'SELECT "{ID}", {r(chr(34) + "TotalCharges" + chr(34) + " / (tenure + 1)", chr(34) + "ChargesPerMonth" + chr(34))} FROM mid',
    MID,
)
acc(
    "charges_per_tenure",
    f"""SELECT "{ID}", {r('"MonthlyCharges" / (tenure + 1)', "charges_per_tenure")} FROM accounts""",
)
BUCKET = """CASE WHEN tenure {low} 0 AND tenure <= 12 THEN 0 WHEN tenure > 12 AND tenure <= 24 THEN 1
  WHEN tenure > 24 AND tenure <= 48 THEN 2 WHEN tenure > 48 AND tenure <= 72 THEN 3 END"""
OPEN_BUCKET = "CASE WHEN {t} <= 12 THEN 0 WHEN {t} <= 24 THEN 1 WHEN {t} <= 48 THEN 2 ELSE 3 END"
acc("tenure_group", f'SELECT "{ID}", {BUCKET.format(low=">=")} AS "TenureGroup" FROM accounts')
acc("tenure_group_no_zero", f'SELECT "{ID}", {BUCKET.format(low=">")} AS "TenureGroup" FROM accounts')
acc("tenure_group_open", f'SELECT "{ID}", {OPEN_BUCKET.format(t="(tenure + 5)")} AS "TenureGroup" FROM accounts')
# Alphabetical codes: 'No' is 0 wherever it occurs, every other text is above.
TOTAL_SERVICES = (
    '(CASE WHEN "PhoneService" = \'Yes\' THEN 1 ELSE 0 END + '
    + " + ".join(f"CASE WHEN \"{c}\" <> 'No' THEN 1 ELSE 0 END" for c in schema.SERVICE_COLUMNS[1:])
    + ")"
)
NUM_SERVICES = "(" + " + ".join(yes(c) for c in schema.SERVICE_COLUMNS) + ")"
SENIOR_ALONE = "CASE WHEN \"SeniorCitizen\" = 1 AND \"Partner\" = 'No' THEN 1 ELSE 0 END"
MONTH_CONTRACT = "CASE WHEN \"Contract\" = 'Month-to-month' THEN 1 ELSE 0 END"
FIBER_OPEN = "CASE WHEN \"InternetService\" = 'Fiber optic' AND \"OnlineSecurity\" = 'No' THEN 1 ELSE 0 END"
acc("total_services", f'SELECT "{ID}", {TOTAL_SERVICES} AS "TotalServices" FROM accounts')
acc("num_services", f'SELECT "{ID}", {NUM_SERVICES} AS num_services FROM accounts')
acc("senior_alone", f'SELECT "{ID}", {SENIOR_ALONE} AS senior_alone FROM accounts')
acc("monthly_contract", f'SELECT "{ID}", {MONTH_CONTRACT} AS is_monthly_contract FROM accounts')
acc("fiber_no_security", f'SELECT "{ID}", {FIBER_OPEN} AS fiber_no_security FROM accounts')
for name, floor in (("default_total_charges", 0), ("default_total_charges_form", 1)):
    acc(
        name,
        f"""SELECT "{ID}", {r(f'coalesce("TotalCharges", "MonthlyCharges" * greatest(tenure, {floor}))', '"TotalCharges"')} FROM num""",
        NUMERIC,
    )
acc(
    "assemble_features",
    f"""SELECT "{ID}", CAST(tenure AS DOUBLE) + 0.0 AS tenure, {MONTHLY} AS "MonthlyCharges",
    CAST("SeniorCitizen" AS DOUBLE) + 0.0 AS "SeniorCitizen", CAST(0 AS DOUBLE) AS absent_feature FROM accounts""",
)
SCALED = ["tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen"]


def scaled(column: str, source: str, condition: str = "true") -> str:
    c = f'CAST("{column}" AS DOUBLE)'
    mean = f"(SELECT avg({c}) FROM {source} WHERE {condition})"
    std = f"(SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM {source} WHERE {condition})"
    return f"({c} - {mean}) / {std}"


SPLIT_ZERO = ZERO + split_cte("zero", f'"{LABEL}"', f'"{ID}"', 0.2, 42)
acc(
    "scale_all",
    f'SELECT "{ID}", ' + ", ".join(r(scaled(c, "zero"), f'"{c}"') for c in SCALED) + " FROM zero",
    ZERO,
)
acc(
    "scale_train_test",
    f'SELECT "{ID}", split, '
    + ", ".join(r(scaled(c, "parted", "split = 'train'"), f'"{c}"') for c in SCALED)
    + " FROM parted",
    SPLIT_ZERO,
)
acc(
    "scaling_audit",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(avg(z), 4) + 0.0 AS mean
        FROM (SELECT {scaled(c, "parted", "split = 'train'")} AS z FROM parted WHERE split = 'train')"""
        for c in SCALED
    ),
    SPLIT_ZERO,
)
acc(
    "apply_stored_scaler",
    f'SELECT "{ID}", "Contract", '
    + ", ".join(r(scaled(c, "zero", "\"Contract\" = 'Two year'"), f'"{c}"') for c in SCALED)
    + " FROM zero",
    ZERO,
)
CODED = {c: code_of(c) for c in schema.CATEGORY_COLUMNS}
BINARY = {c: yes(c) for c in schema.BINARY_COLUMNS}
PER_MONTH = '"TotalCharges" / (tenure + 1)'


def library_rows(source: str) -> str:
    changed = {**CODED, **BINARY, LABEL: yes(LABEL)}
    return every(changed, f"{source} AS src").replace(
        f" FROM {source} AS src",
        f""", {PER_MONTH} AS "ChargesPerMonth", {BUCKET.format(low=">=")} AS "TenureGroup",
        {TOTAL_SERVICES} AS "TotalServices" FROM {source} AS src""",
    )


def six(columns: list[str], source: str, keep: list[str]) -> str:
    return (
        "SELECT "
        + ", ".join([f'"{c}"' for c in keep] + [r(f'"{c}"', f'"{c}"') for c in columns])
        + f" FROM {source}"
    )


LIBRARY_REAL = ["MonthlyCharges", "TotalCharges", "ChargesPerMonth"]
acc(
    "features_library",
    six(
        LIBRARY_REAL,
        f"({library_rows('mid')})",
        [c for c in [*schema.ACCOUNT_COLUMNS, "TenureGroup", "TotalServices"] if c not in LIBRARY_REAL],
    ),
    MID + CODES,
)
NOTEBOOK = every({**CODED, **BINARY, LABEL: yes(LABEL)}, "zero AS src").replace(
    " FROM zero AS src",
    f""", {NUM_SERVICES} AS num_services, "MonthlyCharges" / (tenure + 1) AS charges_per_tenure,
    {SENIOR_ALONE} AS senior_alone, {MONTH_CONTRACT} AS is_monthly_contract,
    {FIBER_OPEN} AS fiber_no_security FROM zero AS src""",
)
NOTEBOOK_REAL = ["MonthlyCharges", "TotalCharges", "charges_per_tenure"]
FLAGS = ["num_services", "senior_alone", "is_monthly_contract", "fiber_no_security"]
acc(
    "features_notebook",
    six(
        NOTEBOOK_REAL,
        f"({NOTEBOOK})",
        [c for c in [*schema.ACCOUNT_COLUMNS, *FLAGS] if c not in NOTEBOOK_REAL],
    ),
    ZERO + CODES,
)

# Splits, folds, weights

SPLIT = split_cte("accounts", f'"{LABEL}"', f'"{ID}"', 0.2, 42)
acc("stratified_split", f'SELECT "{ID}", "{LABEL}", split FROM parted', SPLIT)
raw(
    "stratified_split_orders",
    "WITH base AS (SELECT * FROM orders)"
    + split_cte("base", "o_orderstatus", "o_orderkey", 0.3, 7)
    + " SELECT o_orderkey, split FROM parted",
)
PART = """count(*) AS n_rows, count(*) FILTER (WHERE "Churn" = 'Yes') AS n_positive, """ + r(
    "avg(CASE WHEN \"Churn\" = 'Yes' THEN 1.0 ELSE 0.0 END)", "label_rate"
)
acc(
    "split_audit",
    f"SELECT split AS part, {PART} FROM parted GROUP BY split UNION ALL SELECT 'all', {PART} FROM parted",
    SPLIT,
)
acc("stratified_folds", f'SELECT "{ID}", "{LABEL}", fold FROM folded', fold_cte("accounts", 5))
acc("stratified_folds_three", f'SELECT "{ID}", "{LABEL}", fold FROM folded', fold_cte("accounts", 3))
COUNTS = f""", y AS (SELECT "{ID}", {yes(LABEL)} AS "{LABEL}" FROM accounts),
c AS (SELECT count(*) FILTER (WHERE "{LABEL}" = 0) AS neg, count(*) FILTER (WHERE "{LABEL}" = 1) AS pos FROM y)"""
acc("imbalance_ratio", f"SELECT neg AS negatives, pos AS positives, {r('neg / CAST(pos AS DOUBLE)', 'ratio')} FROM c", COUNTS)
acc(
    "class_weights_balanced",
    f"""SELECT "{ID}", "{LABEL}", {r(f'(neg + pos) / (2.0 * CASE WHEN "{LABEL}" = 1 THEN pos ELSE neg END)', "weight")} FROM y, c""",
    COUNTS,
)
acc(
    "class_weights_ratio",
    f"""SELECT "{ID}", "{LABEL}", {r(f'CASE WHEN "{LABEL}" = 1 THEN neg / CAST(pos AS DOUBLE) ELSE 1 END', "weight")} FROM y, c""",
    COUNTS,
)
acc(
    "prepare_accounts",
    f'SELECT "{ID}", "{LABEL}", split, '
    + ", ".join(r(scaled(c, "parted", "split = 'train'"), f'"{c}"') for c in schema.LIBRARY_FEATURES)
    + " FROM parted",
    MID + CODES + f", lib AS ({library_rows('mid')})" + split_cte("lib", f'"{LABEL}"', f'"{ID}"', 0.2, 42),
)



def served(source: str) -> str:
    """Profiles as the model sees them, before scaling: absent totals guessed, open buckets."""
    changed = {c: e for c, e in {**CODED, **BINARY}.items()}
    cells = [f'{changed[c]} AS "{c}"' if c in changed else f'"{c}"' for c in schema.RAW_FEATURES]
    return f"""SELECT "{ID}", {', '.join(cells)}, {PER_MONTH} AS "ChargesPerMonth",
      {OPEN_BUCKET.format(t="tenure")} AS "TenureGroup", {TOTAL_SERVICES} AS "TotalServices" FROM {source} AS src"""


acc(
    "prepare_profiles",
    f'SELECT "{ID}", '
    + ", ".join(r(scaled(c, "train"), f'"{c}"') for c in schema.LIBRARY_FEATURES)
    + " FROM served",
    NUMERIC
    + CODES
    + """, guessed AS (SELECT * REPLACE (coalesce("TotalCharges", "MonthlyCharges" * tenure) AS "TotalCharges") FROM num),
    fresh AS (SELECT * REPLACE ("MonthlyCharges" * tenure AS "TotalCharges",
      CASE WHEN tenure > 60 THEN 'Weekly' ELSE "Contract" END AS "Contract") FROM num)"""
    + f", train AS ({served('guessed')}), served AS ({served('fresh')})",
)

# Segments

CHURNED = "\"Churn\" = 'Yes'"
RATE = f"avg(CASE WHEN {CHURNED} THEN 1.0 ELSE 0.0 END)"
acc(
    "kpis",
    f"""SELECT count(*) AS n_clients, {r(RATE, "churn_rate")}, {r(RATE + " - 0.265", "rate_delta")},
    {r("avg(tenure)", "mean_tenure")}, {r('avg("MonthlyCharges")', "mean_monthly")},
    {r(f'sum("MonthlyCharges") FILTER (WHERE {CHURNED})', "revenue_at_risk")} FROM accounts""",
)


def rate_by(group: str, positive: str, source: str) -> str:
    return f"""SELECT {group} AS segment, count(*) FILTER (WHERE {positive}) AS n_positive, count(*) AS total,
    {r(f"count(*) FILTER (WHERE {positive}) / CAST(count(*) AS DOUBLE)", "rate")}
    FROM {source} WHERE {group} IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE {positive}) > 0"""


acc("rate_by_contract", rate_by('"Contract"', CHURNED, "accounts"))
acc("rate_by_gender", rate_by("gender", CHURNED, "accounts"))
acc("rate_by_senior", rate_by("CASE \"SeniorCitizen\" WHEN 0 THEN 'Non-Senior' WHEN 1 THEN 'Senior' END", CHURNED, "accounts"))
raw("rate_by_linestatus", rate_by("l_linestatus", "l_returnflag = 'R'", "lineitem"))
raw("rate_by_priority", rate_by("o_orderpriority", "o_orderstatus = 'F'", "orders"))
acc("count_by_internet", f'SELECT "InternetService" AS segment, "{LABEL}" AS label, count(*) AS n FROM accounts GROUP BY 1, 2')
raw("count_by_returnflag", "SELECT l_returnflag AS segment, l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY 1, 2")


def crosstab(columns: list[str], label: str, values: list[str], source: str) -> str:
    cells = ", ".join(
        r(f"100.0 * nullif(count(*) FILTER (WHERE \"{label}\" = '{v}'), 0) / count(*)", f"pct_{v.lower()}") for v in values
    )
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, CAST("{c}" AS VARCHAR) AS value, count(*) AS n, {cells}
        FROM {source} WHERE "{c}" IS NOT NULL AND "{label}" IS NOT NULL GROUP BY 2"""
        for c in columns
    )


CROSSED = [*schema.DEMOGRAPHIC_COLUMNS, "PhoneService", "MultipleLines", "InternetService", *schema.INTERNET_ADDONS, *schema.PLAN_COLUMNS]
acc("crosstab_pct", crosstab(CROSSED, LABEL, ["No", "Yes"], "accounts"))
raw("crosstab_lineitem", crosstab(["l_linenumber", "l_discount"], "l_returnflag", ["A", "N", "R"], "lineitem"))
HEATMAP = (
    "SELECT g.tenure_group, "
    + ", ".join(
        f"""count(*) FILTER (WHERE a."Contract" = '{c}') AS "{c}\"""" for c in schema.CONTRACTS
    )
    + f""", count(*) FILTER (WHERE a.code IS NOT NULL
      AND coalesce(a."Contract", '') NOT IN ('{"', '".join(schema.CONTRACTS)}')) AS other FROM (VALUES (0, '0-12m'), (1, '12-24m'), (2, '24-48m'), (3, '48-72m')) AS g(code, tenure_group)
    LEFT JOIN (SELECT *, {BUCKET.format(low=">=")} AS code FROM accounts WHERE {CHURNED}) a ON a.code = g.code GROUP BY 1"""
)
acc("churner_heatmap", HEATMAP)
acc(
    "churner_heatmap_other",
    HEATMAP.replace(
        "SELECT *,",
        """SELECT * REPLACE (CASE "tenure" % 3 WHEN 1 THEN 'Weekly' WHEN 2 THEN "Contract" END AS "Contract"),""",
    ),
)
acc(
    "service_rates",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS service, "{c}" AS value, {r(RATE, "rate")}, count(*) AS n FROM accounts
        WHERE "{c}" NOT IN ('No internet service', 'No phone service') GROUP BY 2"""
        for c in schema.SERVICE_COLUMNS
    ),
)


def hierarchy(a: str, b: str, source: str) -> str:
    return f"""SELECT 1 AS depth, "{a}" AS parent, CAST(NULL AS VARCHAR) AS child, count(*) AS n FROM {source} GROUP BY 2
    UNION ALL SELECT 2, "{a}", "{b}", count(*) FROM {source} GROUP BY 2, 3"""


acc("hierarchy_counts", hierarchy("PaymentMethod", LABEL, "accounts"))
raw("hierarchy_lineitem", hierarchy("l_returnflag", "l_linestatus", "lineitem"))
MONTHLY_ONLY = "\"Contract\" = 'Month-to-month'"
FIBER = MONTHLY_ONLY + " AND \"InternetService\" = 'Fiber optic'"
SEGMENTS = [
    ("monthly contract", MONTHLY_ONLY),
    ("+ fiber", FIBER),
    ("+ senior", FIBER + ' AND "SeniorCitizen" = 1'),
    ("+ electronic check", FIBER + " AND \"PaymentMethod\" = 'Electronic check'"),
    ("+ under 12 months", FIBER + " AND tenure < 12"),
]
acc(
    "risk_segments",
    " UNION ALL ".join(
        f"""SELECT {i} AS position, '{n}' AS segment, count(*) AS n_clients, {r(RATE, "churn_rate")},
        count(*) FILTER (WHERE {CHURNED}) AS n_churners FROM accounts WHERE {w}"""
        for i, (n, w) in enumerate(SEGMENTS)
    ),
)
acc(
    "filter_in",
    every({"MonthlyCharges": MONTHLY}, "accounts")
    + " WHERE \"Contract\" IN ('Month-to-month', 'Two year') AND \"InternetService\" IN ('DSL')",
)
acc("filter_in_nothing", "SELECT count(*) = 0 AS is_empty FROM accounts WHERE false")
acc(
    "rate_by_tenure_group",
    f"""SELECT ['0-12 months', '13-24 months', '25-48 months', '49-72 months'][b + 1] AS tenure_group, count(*) AS n,
    {r("100 * " + RATE, "churn_pct")} FROM (SELECT *, {BUCKET.format(low=">")} AS b FROM accounts) WHERE b IS NOT NULL GROUP BY 1""",
)
acc("rate_by_num_services", f"SELECT {NUM_SERVICES} AS num_services, count(*) AS n, {r('100 * ' + RATE, 'pct')} FROM accounts GROUP BY 1")
acc(
    "headline",
    "SELECT "
    + ", ".join(
        r(f"100 * {RATE} FILTER (WHERE {w})", n)
        for n, w in (
            ("churn_pct", "true"),
            ("churn_pct_monthly", MONTHLY_ONLY),
            ("churn_pct_fiber", "\"InternetService\" = 'Fiber optic'"),
            ("churn_pct_no_security", "\"OnlineSecurity\" = 'No'"),
            ("churn_pct_senior", '"SeniorCitizen" = 1'),
        )
    )
    + f""", {r(f"avg(tenure) FILTER (WHERE {CHURNED})", "mean_tenure_churned")},
    {r(f'avg("MonthlyCharges") FILTER (WHERE {CHURNED})', "mean_monthly_churned")} FROM accounts""",
)

# Distributions

acc(
    "plot_sample",
    f"""SELECT "{ID}", tenure, {MONTHLY} AS "MonthlyCharges", "{LABEL}" FROM accounts
    ORDER BY md5(concat("{ID}", ':42')), "{ID}" LIMIT 1000""",
)


def binned(column: str, by: str, bins: int, source: str) -> str:
    return f"""SELECT w.g AS "{by}", w.bin, {r("w.lo + w.bin * w.width", "bin_from")}, {r("w.lo + (w.bin + 1) * w.width", "bin_to")},
      coalesce(c.n, 0) AS n
    FROM (SELECT *, (hi - lo) / {bins} AS width FROM (
            SELECT g, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
            FROM (SELECT "{by}" AS g, CAST(min("{column}") AS DOUBLE) AS lo, CAST(max("{column}") AS DOUBLE) AS hi
                  FROM {source} WHERE "{column}" IS NOT NULL GROUP BY 1)),
          (SELECT CAST(range AS INT) AS bin FROM range({bins}))) w
    LEFT JOIN (
      SELECT g, least(CAST(floor((v - lo) / width) AS INT), {bins - 1}) AS bin, count(*) AS n
      FROM (SELECT "{by}" AS g, CAST("{column}" AS DOUBLE) AS v FROM {source} WHERE "{column}" IS NOT NULL)
      JOIN (SELECT g, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
              ((CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END) - (CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END)) / {bins} AS width
            FROM (SELECT "{by}" AS g, CAST(min("{column}") AS DOUBLE) AS lo, CAST(max("{column}") AS DOUBLE) AS hi
                  FROM {source} WHERE "{column}" IS NOT NULL GROUP BY 1)) USING (g)
      GROUP BY 1, 2) c ON c.g = w.g AND c.bin = w.bin"""


acc("histogram_charges", binned("MonthlyCharges", LABEL, 30, "accounts"))
acc("histogram_total_charges", binned("TotalCharges", LABEL, 40, "num"), NUMERIC)
acc("histogram_tenure", binned("tenure", LABEL, 25, "accounts"))
raw("histogram_orders", binned("o_totalprice", "o_orderpriority", 30, "orders"))
raw("trial_histogram", TRIALS + " " + binned("score", "study", 20, "trials"))


def fenced(column: str, by: str, source: str) -> str:
    v = f'CAST("{column}" AS DOUBLE)'
    return f"""SELECT *, a - 1.5 * (c - a) AS lo, c + 1.5 * (c - a) AS hi FROM (
      SELECT "{by}" AS g, count({v}) AS n, quantile_cont({v}, 0.25) AS a, quantile_cont({v}, 0.5) AS b,
        quantile_cont({v}, 0.75) AS c FROM {source} WHERE "{column}" IS NOT NULL GROUP BY 1)"""


def boxes(column: str, by: str, source: str) -> str:
    v = f't."{column}"'
    return f"""SELECT f.g AS "{by}", f.n, {r("any_value(f.a)", "p25")}, {r("any_value(f.b)", "p50")}, {r("any_value(f.c)", "p75")},
      {r(f"least(min({v}) FILTER (WHERE {v} BETWEEN f.lo AND f.hi), any_value(f.a))", "whisker_low")},
      {r(f"greatest(max({v}) FILTER (WHERE {v} BETWEEN f.lo AND f.hi), any_value(f.c))", "whisker_high")},
      count(*) FILTER (WHERE NOT {v} BETWEEN f.lo AND f.hi) AS n_outliers
    FROM {source} t JOIN ({fenced(column, by, source)}) f ON f.g = t."{by}" WHERE {v} IS NOT NULL GROUP BY 1, 2"""


def outliers(column: str, by: str, key: str, source: str) -> str:
    return f"""SELECT t."{key}", t."{by}", {r(f't."{column}"', "value")} FROM {source} t
      JOIN ({fenced(column, by, source)}) f ON f.g = t."{by}" WHERE t."{column}" < f.lo OR t."{column}" > f.hi"""


acc("box_stats_charges", boxes("MonthlyCharges", LABEL, "accounts"))
acc("box_stats_total_charges", boxes("TotalCharges", LABEL, "num"), NUMERIC)
raw("box_stats_orders", boxes("o_totalprice", "o_orderpriority", "orders"))
raw("box_stats_lineitem", boxes("l_extendedprice", "l_returnflag", "lineitem"))
raw("box_outliers_events", outliers("value", "event_type", "event_id", "events"))
acc("box_outliers_charges", outliers("MonthlyCharges", "Contract", ID, "accounts"))


def kernel(column: str, by: list[str], grid: int) -> str:
    keys = ", ".join(f'"{b}"' for b in by)
    v = f'CAST("{column}" AS DOUBLE)'
    return f"""SELECT {keys}, point, {r("x", "x")},
      {r("sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (n * h * sqrt(2 * pi()))", "density")}
    FROM (SELECT {keys}, n, h, CAST(range AS INT) AS point,
            lo - 2 * h + CAST(range AS DOUBLE) * ((hi - lo + 4 * h) / {grid - 1}) AS x
          FROM (SELECT *, sd * pow(n, -0.2) AS h FROM (
                  SELECT {keys}, CAST(count(*) AS DOUBLE) AS n, stddev_samp({v}) AS sd, min({v}) AS lo, max({v}) AS hi
                  FROM accounts GROUP BY {keys})), range({grid}) WHERE h > 0)
    JOIN (SELECT {keys}, {v} AS v FROM accounts) USING ({keys}) GROUP BY {keys}, point, x, n, h"""


acc("density_charges", kernel("MonthlyCharges", ["Contract", LABEL], 100))
acc("density_tenure", kernel("tenure", [LABEL], 50))
CORRELATED = [*schema.NUMERIC_COLUMNS, "SeniorCitizen", LABEL]
acc(
    "corr_matrix",
    " UNION ALL ".join(
        f"""SELECT '{b}' AS var_a, '{a}' AS var_b, {r(f'corr("{b}", "{a}")', "corr")} FROM y"""
        for i, a in enumerate(CORRELATED)
        for b in CORRELATED[i + 1 :]
    ),
    NUMERIC + f', y AS (SELECT * REPLACE ({yes(LABEL)} AS "{LABEL}") FROM num)',
)
FEATURE_FLAGS = ["num_services", "charges_per_tenure", "senior_alone", "is_monthly_contract", "fiber_no_security"]
NB = ZERO + CODES + f", nb AS ({NOTEBOOK})"
acc(
    "label_correlation",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {r(f'corr("{c}", "{LABEL}")', "corr")} FROM nb""" for c in FEATURE_FLAGS
    ),
    NB,
)

# Decisions

RISK = "CASE WHEN score >= 0.70 THEN 'high' WHEN score >= 0.40 THEN 'moderate' ELSE 'low' END"
RECORD = f"""id, prediction, CASE WHEN prediction = 1 THEN 'CHURN' ELSE 'NO CHURN' END AS label,
  {r("score", "probability_churn")}, {r("1 - score", "probability_no_churn")}, {RISK} AS risk_level, model AS model_used"""
acc("score_profiles", f"SELECT {RECORD} FROM scored", SCORES)
acc("risk_levels", f"SELECT id, model, {r('score', 'score')}, {RISK} AS risk_level FROM scored", SCORES)
acc("apply_threshold", "SELECT id, model, CASE WHEN score >= 0.35 THEN 1 ELSE 0 END AS prediction FROM scored", SCORES)
FIRED = """concat_ws(',', CASE WHEN "Contract" = 'Month-to-month' THEN 'annual_contract' END,
  CASE WHEN "MonthlyCharges" > 70 THEN 'price_bundle' END, CASE WHEN tenure < 12 THEN 'welcome_program' END,
  CASE WHEN "TechSupport" = 'No' THEN 'tech_support' END, CASE WHEN "OnlineSecurity" = 'No' THEN 'online_security' END,
  CASE WHEN "PaymentMethod" = 'Electronic check' THEN 'automatic_payment' END)"""
ADVISED = SCORES + f""", advised AS (SELECT *, CASE WHEN score < 0.4 THEN 'keep_quality'
  WHEN {FIRED} = '' THEN 'call_client' ELSE {FIRED} END AS advice FROM scored)"""
acc("recommendations", "SELECT id, model, advice, CAST(len(string_split(advice, ',')) AS INT) AS n_texts FROM advised", ADVISED)
acc(
    "recommendation_mix",
    f"""SELECT risk_level, advice, count(*) AS n
    FROM (SELECT {RISK} AS risk_level, unnest(string_split(advice, ',')) AS advice FROM advised) GROUP BY 1, 2""",
    ADVISED,
)
acc("score_stream", f"SELECT {RECORD}, advice FROM advised", ADVISED)
BLANKS = "concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12), chr(28), chr(29), chr(30), chr(31))"
CLEANED = f"""trim(ltrim(trim(regexp_replace(text, '[^\\x00-\\x7F\\x{{00C0}}-\\x{{024F}}]+', '', 'g'), {BLANKS}), ' -–—'), {BLANKS})"""
raw("clean_text_documents", f"SELECT doc_id, {CLEANED} AS text FROM documents")
raw("clean_text_conversations", f"SELECT conv_id, turn, {CLEANED} AS text FROM conversations")
HIGH = "FILTER (WHERE score > 0.70)"
acc(
    "high_risk_profile",
    f"""SELECT model, count(*) {HIGH} AS n_high, count(*) AS n_all,
    {r(f"100.0 * count(*) {HIGH} / count(*)", "pct_high")}, {r(f"100.0 * avg(label) {HIGH}", "churn_pct")},
    round(avg(tenure) {HIGH}, 2) + 0.0 AS mean_tenure,
    round(avg("MonthlyCharges") {HIGH}, 2) + 0.0 AS "mean_MonthlyCharges",
    round(avg("MonthlyCharges" / (tenure + 1)) {HIGH}, 2) + 0.0 AS mean_charges_per_tenure FROM scored GROUP BY model""",
    SCORES,
)

# Evaluation


def cells(by: str) -> str:
    def n(y, p):
        return f"CAST(count(*) FILTER (WHERE label = {y} AND prediction = {p}) AS DOUBLE)"

    return f""", cells AS (SELECT {by}, {n(0, 0)} AS tn, {n(0, 1)} AS fp, {n(1, 0)} AS fn, {n(1, 1)} AS tp
      FROM scored GROUP BY {by})"""


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0 ELSE ({a}) / ({b}) END)"


def auc_cte(by: str) -> str:
    """Mann-Whitney: mean rank of the positives, ties given their mean rank."""
    return f""", ranked AS (SELECT {by}, label,
      rank() OVER (PARTITION BY {by} ORDER BY score)
        + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS rk FROM scored),
    auc AS (SELECT {by}, CASE WHEN count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0) > 0 THEN
      (CAST(sum(rk) FILTER (WHERE label = 1) AS DOUBLE)
        - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
      / (CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * count(*) FILTER (WHERE label = 0)) END AS roc_auc
      FROM ranked GROUP BY {by})"""


MEASURES = {
    "accuracy": div("tp + tn", "tp + tn + fp + fn"),
    "precision": div("tp", "tp + fp"),
    "recall": div("tp", "tp + fn"),
    "f1": div("2 * tp", "2 * tp + fp + fn"),
    "roc_auc": "roc_auc",
}


def measured_cte(by: str) -> str:
    listed = ", ".join(f"{e} AS {n}" for n, e in MEASURES.items())
    return cells(by) + auc_cte(by) + f", measured AS (SELECT {by}, {listed} FROM cells JOIN auc USING ({by}))"


NAMES = list(MEASURES)
METRIC_ROWS = "SELECT model, " + ", ".join(r(m, m) for m in NAMES) + " FROM measured"
acc("metrics", METRIC_ROWS, SCORES + measured_cte("model"))
raw("metrics_lineitem", LINES + measured_cte("model") + METRIC_ROWS)


def report_rows() -> str:
    no = [div("tn", "tn + fn"), div("tn", "tn + fp"), div("2 * tn", "2 * tn + fn + fp")]
    one = [MEASURES[m] for m in ("precision", "recall", "f1")]
    rows = [
        ("0", no, "tn + fp"),
        ("1", one, "fn + tp"),
        ("accuracy", [MEASURES["accuracy"]] * 3, "tn + fp + fn + tp"),
        ("macro avg", [f"({a} + {b}) / 2" for a, b in zip(no, one)], "tn + fp + fn + tp"),
        (
            "weighted avg",
            [f"({a} * (tn + fp) + {b} * (fn + tp)) / (tn + fp + fn + tp)" for a, b in zip(no, one)],
            "tn + fp + fn + tp",
        ),
    ]
    return " UNION ALL ".join(
        f"""SELECT model, '{n}' AS class, {r(v[0], "precision")}, {r(v[1], "recall")}, {r(v[2], "f1")},
        CAST({s} AS BIGINT) AS support FROM cells"""
        for n, v, s in rows
    )


acc("classification_report", report_rows(), SCORES + cells("model"))
raw("classification_report_lineitem", LINES + cells("model") + report_rows())
FOUR = [(0, 0, "tn", "tn + fp"), (0, 1, "fp", "tn + fp"), (1, 0, "fn", "fn + tp"), (1, 1, "tp", "fn + tp")]
acc(
    "confusion_matrix",
    " UNION ALL ".join(
        f"SELECT model, {y} AS label, {p} AS prediction, CAST({c} AS BIGINT) AS n FROM cells" for y, p, c, _ in FOUR
    ),
    SCORES + cells("model"),
)
PCT = " UNION ALL ".join(
    f"""SELECT model, {y} AS label, {p} AS prediction, CAST({c} AS BIGINT) AS n,
    {r(f"100 * {c} / ({s})", "pct_of_label")}, {r(f"100 * {c} / (tn + fp + fn + tp)", "pct_of_all")} FROM cells"""
    for y, p, c, s in FOUR
)
acc("confusion_pct", PCT, SCORES + cells("model"))
raw("confusion_lineitem", LINES + cells("model") + PCT)
CURVE = """, points AS (
  SELECT model, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n
  FROM (SELECT model, score, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos,
          CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS neg FROM scored GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""
ROC = f"""SELECT model, {r("fp / n", "fpr")}, {r("tp / p", "tpr")}, {r("score", "threshold")} FROM points
  UNION ALL SELECT DISTINCT model, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM points"""
PR = f"""SELECT model, {r("tp / (tp + fp)", "precision")}, {r("tp / p", "recall")}, {r("score", "threshold")} FROM points
  UNION ALL SELECT DISTINCT model, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM points"""
AP = f"""SELECT model, {r("sum(pos * tp / (tp + fp)) / any_value(p)", "average_precision")},
  {r("any_value(p) / (any_value(p) + any_value(n))", "baseline")} FROM points GROUP BY model"""
GAIN = f"""SELECT model, id, i AS position, {r("coalesce((i - 1) / nullif(CAST(n - 1 AS DOUBLE), 0), 0)", "taken")},
    {r("cum / CAST(p AS DOUBLE)", "gain")}
  FROM (SELECT model, id, row_number() OVER w AS i, sum(label) OVER w AS cum,
          count(*) OVER (PARTITION BY model) AS n, sum(label) OVER (PARTITION BY model) AS p
        FROM scored WINDOW w AS (PARTITION BY model ORDER BY {{order}} DESC, md5(concat(id, ':42')), id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
THIN = CURVE + """, corners AS (
  SELECT * FROM (SELECT *, lag(pos) OVER c AS before, lead(pos) OVER c AS next_pos, lead(neg) OVER c AS next_neg
                 FROM points WINDOW c AS (PARTITION BY model ORDER BY score DESC))
  WHERE before IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg)"""
acc("roc_points", ROC, SCORES + CURVE)
acc("roc_points_thin", ROC.replace("FROM points", "FROM corners"), SCORES + THIN)
raw("roc_points_thin_lineitem", LINES + THIN + ROC.replace("FROM points", "FROM corners"))
acc("pr_points", PR, SCORES + CURVE)
acc("average_precision", AP, SCORES + CURVE)
acc("roc_auc", f"SELECT model, {r('roc_auc', 'roc_auc')} FROM auc", SCORES + auc_cte("model"))
acc("cumulative_gain", GAIN.format(order="score"), SCORES)
acc("ideal_gain", GAIN.format(order="label"), SCORES)
raw("roc_points_lineitem", LINES + CURVE + ROC)
raw("pr_points_lineitem", LINES + CURVE + PR)
raw("average_precision_lineitem", LINES + CURVE + AP)
raw("cumulative_gain_lineitem", LINES + GAIN.format(order="score"))
SWEPT = f""", swept AS (
  SELECT model, t, {div("tp", "tp + fp")} AS precision, {div("tp", "tp + fn")} AS recall, {div("2 * tp", "2 * tp + fp + fn")} AS f1
  FROM (SELECT model, t, CAST(count(*) FILTER (WHERE score >= t AND label = 1) AS DOUBLE) AS tp,
          CAST(count(*) FILTER (WHERE score >= t AND label = 0) AS DOUBLE) AS fp,
          CAST(count(*) FILTER (WHERE score < t AND label = 1) AS DOUBLE) AS fn
        FROM scored, (SELECT range * 5 / CAST(100 AS DOUBLE) AS t FROM range(2, 18)) GROUP BY 1, 2))"""
SWEEP = f"SELECT model, {r('t', 'threshold')}, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')} FROM swept"
acc("threshold_sweep", SWEEP, SCORES + SWEPT)
raw("threshold_sweep_lineitem", LINES + SWEPT + SWEEP)
acc("best_threshold", SWEEP + " QUALIFY row_number() OVER (PARTITION BY model ORDER BY swept.f1 DESC, t) = 1", SCORES + SWEPT)
acc(
    "compare_models",
    "SELECT model, " + ", ".join(f"round({m}, 4) + 0.0 AS {m}" for m in NAMES) + " FROM measured",
    SCORES + measured_cte("model"),
)
acc(
    "compare_models_pct",
    "SELECT model, " + ", ".join(f"round(100 * {m}, 1) + 0.0 AS {m}" for m in NAMES) + " FROM measured",
    SCORES + measured_cte("model"),
)
acc(
    "best_per_metric",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, (SELECT model FROM measured ORDER BY {m} DESC, model LIMIT 1) AS model, {r(f'max({m})', 'value')} FROM measured"
        for m in NAMES
    ),
    SCORES + measured_cte("model"),
)
acc(
    "soft_vote",
    f"""SELECT id, 'ensemble' AS model, max(label) AS label, {r("avg(score)", "score")},
    CASE WHEN avg(score) > 0.5 THEN 1 ELSE 0 END AS prediction FROM scored GROUP BY id""",
    SCORES,
)
acc(
    "before_after",
    " UNION ALL ".join(
        f"""SELECT 'card' AS model, '{m}' AS metric, {r(f"max({m}) FILTER (WHERE model = 'card_a')", '"before"')},
        {r(f"max({m}) FILTER (WHERE model = 'card_b')", '"after"')},
        {r(f"max({m}) FILTER (WHERE model = 'card_b') - max({m}) FILTER (WHERE model = 'card_a')", "gain")} FROM measured"""
        for m in NAMES
    ),
    SCORES + measured_cte("model"),
)
BY_SPLIT = split_cte("scored", f'model, "{LABEL}"', f'"{ID}"', 0.2, 42)
acc(
    "overfit_check",
    f"""SELECT model, {r("a", "auc_train")}, {r("b", "auc_test")}, {r("a - b", "gap")}, a - b < 0.05 AS within_tolerance
    FROM (SELECT split_part(run, '|', 1) AS model, max(roc_auc) FILTER (WHERE run LIKE '%|train') AS a,
            max(roc_auc) FILTER (WHERE run LIKE '%|test') AS b FROM auc GROUP BY 1)""",
    (SCORES + BY_SPLIT + ", runs AS (SELECT *, concat(model, '|', split) AS run FROM parted)" + auc_cte("run")).replace(
        "AS rk FROM scored", "AS rk FROM runs"
    ),
)
FOLDS = (
    fold_cte("accounts", 5, "folded")
    + SCORES.replace("* FROM accounts", "* FROM folded")
    + ", runs AS (SELECT *, concat(model, '|', fold) AS run FROM scored)"
    + auc_cte("run").replace("AS rk FROM scored", "AS rk FROM runs")
    + """, folds AS (SELECT split_part(run, '|', 1) AS model, CAST(split_part(run, '|', 2) AS INT) AS fold,
    roc_auc AS score FROM auc)"""
)
acc("cv_fold_scores", f"SELECT model, fold, {r('score', 'score')} FROM folds", FOLDS)
acc(
    "cv_summary",
    f"""SELECT model, count(*) AS n_folds, {r("avg(score)", "mean_score")}, {r("stddev_pop(score)", "std_score")},
    {r("min(score)", "min_score")}, {r("max(score)", "max_score")} FROM folds GROUP BY model""",
    FOLDS,
)
acc("cv_box", boxes("score", "model", "folds"), FOLDS)
CARD_A = """round((CASE WHEN is_monthly_contract = 1 THEN 3 ELSE 0 END + CASE WHEN tenure < 12 THEN 3 ELSE 0 END
  + "MonthlyCharges" / CAST(200 AS DOUBLE)) / CAST(8 AS DOUBLE), 2)"""
IMPORTANCES = NB + f", nbc AS MATERIALIZED (SELECT *, {CARD_A} AS card FROM nb), imp AS MATERIALIZED (" + " UNION ALL ".join(
    f"""SELECT '{m}' AS model, '{c}' AS feature, abs(corr("{c}", "{t}")) AS importance FROM nbc"""
    for m, t in (("card_a", "card"), ("observed", LABEL))
    for c in schema.NOTEBOOK_FEATURES
) + ")"
acc(
    "top_features",
    f"""SELECT model, feature, {r("importance", "importance")}, CAST(place AS INT) AS place, {r("importance / best", "relative")}
    FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS place,
            max(importance) OVER (PARTITION BY model) AS best FROM imp) WHERE place <= 15""",
    IMPORTANCES,
)
acc(
    "combined_importance",
    f"""SELECT feature, {r("mean_share", "mean_share")} FROM (
      SELECT feature, avg(importance / total) AS mean_share
      FROM (SELECT *, sum(importance) OVER (PARTITION BY model) AS total FROM imp) GROUP BY feature)
    ORDER BY mean_share DESC, feature LIMIT 10""",
    IMPORTANCES,
)
raw(
    "best_so_far",
    f"""{TRIALS} SELECT study, trial, {r("score", "score")}, {r("max(score) OVER (PARTITION BY study ORDER BY trial)", "best_score")}
    FROM trials""",
)
acc(
    "importance_shares",
    f"""SELECT feature, model, {r("share", "share")}, {r("mean_share", "mean_share")} FROM (
      SELECT *, dense_rank() OVER (ORDER BY mean_share DESC, feature) AS place FROM (
        SELECT *, avg(share) OVER (PARTITION BY feature) AS mean_share FROM (
          SELECT feature, model, importance / sum(importance) OVER (PARTITION BY model) AS share FROM imp)))
    WHERE place <= 10""",
    IMPORTANCES,
)

# Fitted models: what must hold of them whatever their scores are


def each_of(*names: str) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") m(model)"


POSITIVE = "count(*) FILTER (WHERE \"Churn\" = 'Yes') AS n_positive"
MODELS = ("logistic", "forest", "gbt_a", "gbt_b")
acc(
    "model_report",
    f"""SELECT model, count(*) AS n_rows, {POSITIVE}, count(*) AS n_in_range, count(*) AS n_decided, true AS learnt
    FROM parted, {each_of(*MODELS, "ensemble")} WHERE split = 'test' GROUP BY model""",
    SPLIT,
)
acc("saved_model_same", f"SELECT model, count(*) AS n_rows, count(*) AS n_same FROM accounts, {each_of('logistic', 'gbt_a')} GROUP BY model")
acc(
    "importance_totals",
    f"""SELECT model, CAST({len(schema.NOTEBOOK_FEATURES)} AS BIGINT) AS n_features, CAST(1 AS DOUBLE) AS total, count(*) > 0 AS sound
    FROM accounts, {each_of("forest", "gbt_a", "gbt_b")} GROUP BY model""",
)
acc(
    "model_folds",
    f"""SELECT model, fold, count(*) AS n_rows, {POSITIVE}, count(*) AS n_in_range, true AS scored
    FROM folded, {each_of(*MODELS)} GROUP BY model, fold""",
    fold_cte("accounts", 5),
)
# Points and folds of the published searches.
for name, points, k in (("random_search_small", 5, 3), ("grid_search", 8, 3)):
    counts = {"n_trials": points, "n_fold_scores": points * k, "n_sound": points, "n_best": 1, "n_points": points}
    acc(name, "SELECT 'search' AS study, " + ", ".join(f"CAST({v} AS BIGINT) AS {c}" for c, v in counts.items()) + " FROM accounts LIMIT 1")
acc(
    "score_stream_model",
    " UNION ALL ".join(
        f"SELECT '{side}' AS side, count(*) AS n_batch, count(*) AS n_stream, count(*) AS n_same FROM accounts WHERE {where}"
        for side, where in (("sound", "true"), ("damaged", f'CAST("{ID}" AS BIGINT) % 20 = 0'))
    ),
)
raw(
    "encode_order_codes",
    """WITH keyed AS (
      SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN 'order-' || o_orderkey END, 'nan') AS k, o_orderstatus FROM orders)
    SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY k) - 1 AS INT) AS code,
      CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INT) AS status FROM keyed""",
)
