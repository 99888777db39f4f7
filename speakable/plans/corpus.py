"""Queries over generated pairs, splits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import score as C
from . import sql as q
from .inputs import ids, scored, table
from .registry import query

_IDS = "SELECT o_orderkey AS id FROM orders"
_SIZES = {"n_train": 3000, "n_val": 400}
_HARD_N = 500


def _sql(builder: str, seed: int) -> tuple[str, str]:
    """(stage, columns): named values of a builder and its carrier, written and spoken form."""

    def d(slot, size):
        return q.draw(slot, size, seed)

    def pk(slot, options):
        return q.pick(slot, options, seed)

    generic = pk(90, P.GENERIC)

    def bare(percent, carriers):
        return f"CASE WHEN {d(91, 100)} < {percent} THEN '{{X}}' ELSE {pk(90, carriers)} END"

    def dec_digits(x):
        return q.digits(x, "zero")

    if builder == "plain":
        return f"{pk(1, P.PLAIN)} AS s", "'{X}' AS carrier, s AS written, s AS said"
    if builder == "cardinal":
        n = f"""CASE {d(1, 4)} WHEN 0 THEN {d(2, 100)} WHEN 1 THEN 100 + {d(2, 900)} WHEN 2 THEN 1000 + {d(2, 99000)}
             ELSE 100000 + {d(2, 9900000)} END"""
        return (
            f"{n} AS n",
            f"""{bare(25, P.GENERIC)} AS carrier, CASE WHEN n >= 1000 AND {d(3, 100)} < 60 THEN {q.grouped('n')}
             ELSE n::VARCHAR END AS written, {q.card('n')} AS said""",
        )
    if builder == "count_in_year_range":
        return f"1500 + {d(1, 600)} AS n", f"{pk(90, P.COUNTS)} AS carrier, n::VARCHAR AS written, {q.card('n')} AS said"
    if builder == "year":
        return f"1500 + {d(1, 526)} AS n", f"{pk(90, P.YEARS)} AS carrier, n::VARCHAR AS written, {q.year('n')} AS said"
    if builder == "decade":
        return (
            f"{pk(1, P.DECADES)}::BIGINT AS n, {q.year('n')} AS w",
            f"""{generic} AS carrier, n || 's' AS written,
             CASE WHEN w LIKE '%y' THEN left(w, length(w) - 1) || 'ies' ELSE w || 's' END AS said""",
        )
    if builder == "ordinal":
        suffix = """CASE WHEN n % 100 IN (11, 12, 13) THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd'
             WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END"""
        return (
            f"1 + {d(1, 120)} AS n, {q.card('n')} AS w",
            f"{bare(25, P.GENERIC)} AS carrier, n || {suffix} AS written, {q.ordinalize('w')} AS said",
        )
    if builder == "decimal":
        tail = f"rtrim(left(lpad(({d(3, 1000)})::VARCHAR, 3, '0'), ({d(1, 3)} + 1)::INT), '0')"
        return (
            f"{d(2, 999)} AS n, CASE WHEN {tail} = '' THEN '0' ELSE {tail} END AS t",
            f"{generic} AS carrier, n || '.' || t AS written, {q.card('n')} || ' point ' || {dec_digits('t')} AS said",
        )
    if builder == "money":
        return (
            f"""{d(1, 100)} < 40 AS short, 10 + {d(2, 91)} AS tenths, {pk(3, ['M', 'B', 'k'])} AS mag, 1 + {d(4, 999999)} AS n,
             CASE WHEN {d(5, 2)} = 0 THEN -1 ELSE {d(6, 100)} END AS c""",
            f"""{generic} AS carrier, CASE WHEN short THEN '$' || tenths // 10 || '.' || tenths % 10 || mag
               ELSE '$' || {q.grouped('n')} || CASE WHEN c < 0 THEN '' ELSE '.' || lpad(c::VARCHAR, 2, '0') END END AS written,
             CASE WHEN short THEN {q.card('tenths // 10')} || ' point ' || b[tenths % 10 + 1] || ' '
               || CASE mag WHEN 'M' THEN 'million' WHEN 'B' THEN 'billion' ELSE 'thousand' END || ' dollars'
               ELSE {q.card('n')} || ' dollars' || CASE WHEN c > 0 THEN ' and ' || b[c + 1] || ' cents' ELSE '' END END AS said""",
        )
    if builder == "measure":
        units = {
            "km": "kilometers", "kg": "kilograms", "cm": "centimeters", "mm": "millimeters", "ml": "milliliters",
            "GB": "gigabytes", "MB": "megabytes", "mph": "miles per hour", "kW": "kilowatts", "%": "percent",
            "ft": "feet", "mi": "miles", "oz": "ounces",
        }
        return (
            f"{d(2, 2)} = 0 AS whole, 1 + {d(3, 999)} AS n, {d(1, 13)} AS u, {d(4, 2)} AS gap",
            f"""{bare(30, P.GENERIC)} AS carrier, CASE WHEN whole THEN n::VARCHAR ELSE n // 10 || '.' || n % 10 END
               || CASE WHEN gap = 0 THEN '' ELSE ' ' END || {q.quoted(list(units))}[u + 1] AS written,
             CASE WHEN whole THEN {q.card('n')} ELSE {q.card('n // 10')} || ' point ' || b[n % 10 + 1] END
               || ' ' || {q.quoted(list(units.values()))}[u + 1] AS said""",
        )
    if builder == "time":
        return (
            f"""1 + {d(1, 12)} AS h, CASE WHEN {d(2, 7)} < 6 THEN [0, 0, 5, 15, 30, 45][least({d(2, 7)}, 5) + 1]
             ELSE 1 + {d(3, 59)} END AS m, {d(4, 3)} AS half""",
            f"""{pk(90, P.TIMES)} AS carrier, h || ':' || lpad(m::VARCHAR, 2, '0') || ['', ' AM', ' PM'][half + 1] AS written,
             b[h + 1] || CASE WHEN m = 0 THEN CASE WHEN half = 0 THEN ' o''clock' ELSE '' END
               WHEN m < 10 THEN ' oh ' || b[m + 1] ELSE ' ' || b[m + 1] END || ['', ' a m', ' p m'][half + 1] AS said""",
        )
    if builder == "fraction":
        return (
            f"{pk(1, P.DENOMINATORS)}::BIGINT AS den, {d(2, 2520)} % (den - 1) + 1 AS num",
            f"""{generic} AS carrier, num || '/' || den AS written, b[num + 1] || ' ' ||
             CASE den WHEN 2 THEN 'half' WHEN 3 THEN 'third' WHEN 4 THEN 'quarter' WHEN 5 THEN 'fifth' WHEN 6 THEN 'sixth'
               WHEN 8 THEN 'eighth' ELSE 'tenth' END || CASE WHEN num = 1 THEN '' ELSE 's' END AS said""",
        )
    if builder == "telephone":
        return (
            f"200 + {d(1, 800)} AS a3, 200 + {d(2, 800)} AS b3, lpad(({d(3, 10000)})::VARCHAR, 4, '0') AS c4, {d(4, 2)} AS form",
            f"""{generic} AS carrier, CASE WHEN form = 0 THEN a3 || '-' || b3 || '-' || c4
               ELSE '(' || a3 || ') ' || b3 || '-' || c4 END AS written, {q.digits('a3 || (b3 || c4)')} AS said""",
        )
    if builder == "electronic":
        return (
            f"""{pk(1, P.HOSTS)} AS host, {pk(2, P.HOST_DOMAINS)} AS tld, {d(3, 2)} = 0 AS web, {pk(4, P.MAILBOXES)} AS box""",
            f"""{generic} AS carrier, CASE WHEN web THEN 'www.' || host || '.' || tld ELSE box || '@' || host || '.' || tld END AS written,
             CASE WHEN web THEN 'w w w dot ' ELSE box || ' at ' END || host || ' dot ' || tld AS said""",
        )
    if builder == "date":
        return (
            f"{pk(1, P.MONTHS)} AS mon, 1 + {d(2, 28)} AS day, 1700 + {d(3, 326)} AS y, b[day + 1] AS w",
            f"""{pk(90, P.DATES)} AS carrier, mon || ' ' || day || ', ' || y AS written,
             mon || ' ' || {q.ordinalize('w')} || ', ' || {q.year('y')} AS said""",
        )
    if builder == "ambiguous_street":
        titles, suffixes = list(P.TITLES), list(P.STREET_SUFFIXES)
        return (
            f"""{d(1, len(titles))} AS ti, {pk(2, P.NAMES)} AS name, 2 + {d(3, 989)} AS n, {pk(4, P.STREETS)} AS street,
             {d(5, len(suffixes))} AS su""",
            f"""'{{X}}' AS carrier, {q.quoted(titles)}[ti + 1] || '. ' || name || ' lived at ' || n || ' ' || street || ' '
               || {q.quoted(suffixes)}[su + 1] || '.' AS written,
             {q.quoted(list(P.TITLES.values()))}[ti + 1] || ' ' || name || ' lived at ' || {q.card('n')} || ' ' || street || ' '
               || {q.quoted(list(P.STREET_SUFFIXES.values()))}[su + 1] || '.' AS said""",
        )
    if builder == "regnal_roman":
        return (
            f"{pk(1, P.REGNAL)} AS name, 1 + {d(2, 20)} AS n, b[n + 1] AS w",
            f"{generic} AS carrier, name || ' ' || {q.roman('n')} AS written, name || ' the ' || {q.ordinalize('w')} AS said",
        )
    if builder == "uncovered_roman":
        return (
            f"{pk(1, P.UNCOVERED)} AS name, 1 + {d(2, 12)} AS n",
            f"{generic} AS carrier, name || ' ' || {q.roman('n')} AS written, name || ' ' || b[n + 1] AS said",
        )
    if builder == "abbreviation":
        spoken = ["mister", "missus", "professor", "et cetera", "versus", "incorporated", "limited", "department", "avenue"]
        return (
            f"{d(1, 9)} AS k, {pk(2, P.NAMES)} AS name",
            f"""'{{X}}' AS carrier, {q.quoted(P.ABBREVIATION_KEYS)}[k + 1] || '. ' || name || ' agreed to the terms.' AS written,
             {q.quoted(spoken)}[k + 1] || ' ' || name || ' agreed to the terms.' AS said""",
        )
    return (
        f"2 + {d(1, 98)} AS n, 1 + {d(2, 99)} AS p",
        """'{X}' AS carrier, 'About ' || n || ' of the ' || p || '% surveyed agreed.' AS written,
           'About ' || b[n + 1] || ' of the ' || b[p + 1] || ' percent surveyed agreed.' AS said""",
    )


def _pairs_sql(builder: str, seed: int = 42, where: str = "TRUE", labels: bool = True) -> str:
    stage, columns = _sql(builder, seed)
    _, _, classes, hard = P.BUILDERS[builder]
    extra = f", {q.quoted(classes)} AS classes, {str(hard).upper()} AS hard" if labels else ""
    return f"""SELECT id AS pair_id, replace(carrier, '{{X}}', written) AS before, replace(carrier, '{{X}}', said) AS after{extra}
        FROM (SELECT id, {columns} FROM (SELECT id, b, {stage} FROM ({_IDS}), ones, below WHERE {where}) s0) s1"""


def _register_builder(name: str) -> None:
    @query(f"build_{name}", f"WITH {q.NUMBER_CTES} {_pairs_sql(name, labels=False)}")
    def one(spark, sf):
        return P.build_pairs(ids(spark, sf), name).select("pair_id", "before", "after")


for _name in P.BUILDERS:
    _register_builder(_name)


def _drawn(seed: int, hard_only: bool) -> str:
    names = P.HARD_BUILDERS if hard_only else list(P.BUILDERS)
    weights = [1 if hard_only else P.BUILDERS[n][1] for n in names]
    ticket, low, parts = q.draw(0, sum(weights), seed), 0, []
    for name, weight in zip(names, weights):
        where = f"{ticket} >= {low} AND {ticket} < {low + weight}"
        parts.append(_pairs_sql(name, seed, where))
        low += weight
    return " UNION ALL ".join(parts)


def _distinct(seed: int, hard_only: bool = False) -> str:
    return f"""SELECT min(pair_id) AS pair_id, before, after, arg_min(classes, pair_id) AS classes,
        arg_min(hard, pair_id) AS hard FROM ({_drawn(seed, hard_only)}) GROUP BY before, after"""


_POOL = _distinct(42)
_HARD = f"SELECT * FROM ({_distinct(42 + 999, True)}) QUALIFY row_number() OVER (ORDER BY pair_id) <= {_HARD_N}"


@query(
    "op_generate_pairs",
    f"WITH {q.NUMBER_CTES} SELECT pair_id, before, after, array_to_string(classes, '+') AS classes, hard FROM ({_POOL})",
)
def generate_pairs(spark, sf):
    return P.generate_pairs(ids(spark, sf)).withColumn("classes", F.array_join("classes", "+"))


@query(
    "op_generate_hard",
    f"WITH {q.NUMBER_CTES} SELECT pair_id, before, after, array_to_string(classes, '+') AS classes, hard FROM ({_HARD})",
)
def generate_hard(spark, sf):
    made = P.generate_pairs(ids(spark, sf), _HARD_N, hard_only=True)
    return made.withColumn("classes", F.array_join("classes", "+"))


_PLACES = f"""p0 AS ({_POOL}), p1 AS (SELECT *, row_number() OVER (ORDER BY {q.draw(99, 2147483647, 42, 'pair_id')}, pair_id) AS place FROM p0)"""
_SPLITS = f"""WITH {q.NUMBER_CTES}, {_PLACES},
  p2 AS (SELECT pair_id, before, after, hard, CASE WHEN place <= {_SIZES['n_train']} THEN 'train'
      WHEN place <= {_SIZES['n_train'] + _SIZES['n_val']} THEN 'val' ELSE 'test' END AS split FROM p1),
  train AS (SELECT * FROM p2 WHERE split = 'train'
      UNION ALL SELECT p_partkey, p_name, p_type, FALSE, 'train' FROM part),
  held AS (SELECT * FROM p2 WHERE split <> 'train' UNION ALL SELECT pair_id, before, after, hard, 'hard' FROM ({_HARD})),
  splits AS (SELECT * FROM train UNION ALL SELECT * FROM held WHERE before NOT IN (SELECT before FROM train)) """


def _splits(spark, sf):
    pool = P.generate_pairs(ids(spark, sf))
    hard = P.generate_pairs(ids(spark, sf), _HARD_N, hard_only=True)
    real = P.load_pairs(table(spark, sf, "part"), "p_name", "p_type", "p_partkey")
    return P.build_splits(pool, hard, _SIZES["n_train"], _SIZES["n_val"], real=real)


@query("op_build_splits", _SPLITS + "SELECT * FROM splits")
def build_splits(spark, sf):
    return _splits(spark, sf).drop("classes")


@query(
    "chk_leakage",
    _SPLITS
    + """, parts AS (SELECT p_brand AS before, CASE WHEN p_partkey % 3 = 0 THEN 'train' ELSE 'test' END AS split FROM part)
        SELECT 'splits' AS source, count(*) AS n_leaks FROM splits WHERE split <> 'train' AND before IN (SELECT before FROM splits WHERE split = 'train')
        UNION ALL SELECT 'parts', count(*) FROM parts WHERE split <> 'train' AND before IN (SELECT before FROM parts WHERE split = 'train')
        UNION ALL SELECT 'clean parts', 0""",
)
def leakage(spark, sf):
    """The built splits, brands split by part key as they are, and the same after the filter."""
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("before"), F.when(F.col("p_partkey") % 3 == 0, "train").otherwise("test").alias("split"))
    train = parts.filter("split = 'train'")
    clean = train.unionByName(P.without_leaks(parts.filter("split <> 'train'"), train))
    named = (("splits", _splits(spark, sf)), ("parts", parts), ("clean parts", clean))
    found = [P.leakage(rows).select(F.lit(name).alias("source"), "n_leaks") for name, rows in named]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("win_shuffle", f"WITH {q.NUMBER_CTES}, {_PLACES} SELECT pair_id, place FROM p1")
def shuffle_rows(spark, sf):
    # Places depend on the ids alone, so no texts are written and sorted with them.
    return P.shuffled(P.generate_pairs(ids(spark, sf)).select("pair_id")).select("pair_id", "place")


@query(
    "set_union_real",
    f"WITH {q.NUMBER_CTES} SELECT before, after FROM ({_POOL}) UNION ALL SELECT p_name, p_type FROM part",
)
def union_real(spark, sf):
    real = P.load_pairs(table(spark, sf, "part"), "p_name", "p_type", "p_partkey")
    return P.generate_pairs(ids(spark, sf)).unionByName(real).select("before", "after")


@query("set_dedup_pairs", "SELECT min(p_partkey) AS pair_id, p_name AS before, p_type AS after FROM part GROUP BY p_name, p_type")
def dedup_pairs(spark, sf):
    real = P.load_pairs(table(spark, sf, "part"), "p_name", "p_type", "p_partkey")
    return P.distinct_pairs(real).select("pair_id", "before", "after")


@query(
    "set_except_train",
    "SELECT doc_id, text AS before FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)",
)
def except_train(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("before"))
    return P.without_leaks(docs, docs.filter(F.col("doc_id") % 3 == 0)).select("doc_id", "before")


@query(
    "join_leakage_anti",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
)
def anti_join(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("before"))
    big = table(spark, sf, "orders").filter(F.col("o_totalprice") > 300_000)
    orders = big.select(F.col("o_custkey").alias("before"))
    return P.without_leaks(customers, orders).select("c_custkey")


@query(
    "op_carriers",
    f"SELECT o_orderkey AS id, replace({q.quoted(P.GENERIC)}[{q.draw(90, 10, 42, 'o_orderkey')} + 1], '{{X}}', o_orderpriority) AS text FROM orders",
)
def carriers(spark, sf):
    orders = table(spark, sf, "orders")
    carrier = P.Draws("o_orderkey", 42).pick(P.CARRIER, P.GENERIC)
    return orders.select(
        F.col("o_orderkey").alias("id"), F.replace(carrier, F.lit("{X}"), F.col("o_orderpriority")).alias("text")
    )


@query(
    "op_sample_cycle",
    f"SELECT c_custkey AS id, {q.quoted(P.PLAIN)}[c_custkey % 6 + 1] AS text FROM customer",
)
def sample_cycle(spark, sf):
    return P.cycle(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), P.PLAIN)


@query(
    "op_signature",
    """SELECT 'synthetic+real' AS source, 'part' AS real, (SELECT count(*) FROM part) AS n_real, 3000::BIGINT AS train,
       400::BIGINT AS val, 100::BIGINT AS test, 500::BIGINT AS hard, 42::BIGINT AS seed""",
)
def signature(spark, sf):
    record = P.signature(spark, 3000, 400, 100, 500, real="part")
    sizes = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n_real"))
    return record.join(F.broadcast(sizes), F.lit(True))


# Scores: labels as gold, a length rule as the model.
_SCORED = """scored AS (SELECT doc_id AS pair_id, lang AS slice, CASE WHEN toxic = 1 THEN ['MONEY', 'PLAIN'] WHEN n_chars % 5 = 0 THEN []
    WHEN n_chars % 2 = 0 THEN ['CARDINAL'] ELSE ['ABBREV'] END AS classes, n_chars::VARCHAR AS before,
    'quality ' || quality AS gold, 'quality ' || CASE WHEN n_chars > 900 THEN '1' ELSE '0' END AS pred, gold = pred AS correct
    FROM labels JOIN documents USING (doc_id)),
  per AS (SELECT slice, cls, count(*) AS n, count(*) FILTER (NOT correct) AS errors,
    round_even((n - errors)::DOUBLE / greatest(1, n), 4) AS accuracy FROM (
      SELECT slice, correct, unnest(CASE WHEN len(classes) = 0 THEN ['PLAIN'] ELSE classes END) AS cls FROM scored) GROUP BY slice, cls),
  total AS (SELECT slice, count(*) AS n, count(*) FILTER (correct) AS n_correct,
    round_even(n_correct::DOUBLE / greatest(1, n), 4) AS sentence_accuracy FROM scored GROUP BY slice),
  macro AS (SELECT slice, round_even(sum(accuracy) / count(*), 4) AS macro_class_accuracy FROM per GROUP BY slice)"""


def _scored(spark, sf):
    rows = scored(spark, sf)
    return C.join_pred_gold(rows.drop("text"), rows.select("pair_id", "text"))


@query("join_pred_gold", f"WITH {_SCORED} SELECT pair_id, slice, correct FROM scored")
def pred_gold(spark, sf):
    return _scored(spark, sf).select("pair_id", "slice", "correct")


@query(
    "agg_score",
    f"WITH {_SCORED} SELECT slice, n, n_correct, macro_class_accuracy, sentence_accuracy FROM total JOIN macro USING (slice)",
)
def scores(spark, sf):
    return C.score(_scored(spark, sf), "slice")


@query("agg_error_classes", f"WITH {_SCORED} SELECT slice, cls, n, errors, accuracy FROM per")
def error_classes(spark, sf):
    return C.class_scores(_scored(spark, sf), "slice")


@query("agg_error_totals", f"WITH {_SCORED} SELECT slice, sum(errors)::BIGINT AS errors FROM per GROUP BY slice")
def error_totals(spark, sf):
    return C.error_totals(_scored(spark, sf), "slice")


@query(
    "agg_unrecoverable",
    f"""WITH {_SCORED} SELECT slice, count(*) AS n, count(*) FILTER (NOT correct AND (list_contains(classes, 'MONEY')
        OR list_contains(classes, 'CARDINAL'))) AS n_unrecoverable, round_even(n_unrecoverable::DOUBLE / n, 4) AS rate FROM scored GROUP BY slice""",
)
def unrecoverable(spark, sf):
    return C.unrecoverable(_scored(spark, sf), "slice")


@query(
    "win_error_examples",
    f"""WITH {_SCORED} SELECT slice, pair_id, gold, pred FROM scored WHERE NOT correct
        QUALIFY row_number() OVER (PARTITION BY slice ORDER BY pair_id) <= 12""",
)
def error_examples(spark, sf):
    from ..functions.expr import squash

    rows = C.error_examples(_scored(spark, sf), 12, ["slice"])
    return rows.select("slice", "pair_id", squash(F.col("after")).alias("gold"), squash(F.col("pred")).alias("pred"))


@query("sort_class_accuracy", f"WITH {_SCORED} SELECT slice, cls, accuracy FROM per ORDER BY accuracy, cls")
def sort_classes(spark, sf):
    return C.worst_classes(C.class_scores(_scored(spark, sf), "slice")).select("slice", "cls", "accuracy")


@query("sort_dict_keys", f"WITH {_SCORED} SELECT cls, sum(n)::BIGINT AS n FROM per GROUP BY cls ORDER BY cls")
def sort_keys(spark, sf):
    return C.class_scores(_scored(spark, sf), "slice").groupBy("cls").agg(F.sum("n").alias("n")).orderBy("cls")


def _model_scores(spark, sf):
    """The length rule against a model that says 1 everywhere."""
    rows = scored(spark, sf)
    gold = rows.drop("text")
    rule = C.score(C.join_pred_gold(gold, rows.select("pair_id", "text")), "slice").withColumn("model", F.lit("rule"))
    ones = rows.select("pair_id", F.lit("quality 1").alias("text"))
    constant = C.score(C.join_pred_gold(gold, ones), "slice").withColumn("model", F.lit("ones"))
    return rule.unionByName(constant)


_ONES = "round_even(count(*) FILTER (gold = 'quality 1')::DOUBLE / count(*), 4)"


@query(
    "agg_compare",
    f"""WITH {_SCORED} SELECT slice, {_ONES} AS model_accuracy, any_value(sentence_accuracy) AS baseline_accuracy,
        round_even(model_accuracy - baseline_accuracy, 4) AS delta, model_accuracy >= baseline_accuracy AS beats_baseline
        FROM scored JOIN (SELECT slice, sentence_accuracy FROM total) USING (slice) GROUP BY slice""",
)
def compare(spark, sf):
    return C.compare(_model_scores(spark, sf), "ones", "rule")


@query(
    "join_model_deltas",
    f"""WITH {_SCORED} SELECT slice, 'sentence_accuracy' AS metric, {_ONES} AS model_value, any_value(sentence_accuracy) AS baseline_value,
        round_even(model_value - baseline_value, 4) AS delta FROM scored JOIN (SELECT slice, sentence_accuracy FROM total) USING (slice) GROUP BY slice""",
)
def model_deltas(spark, sf):
    both = _model_scores(spark, sf).select(
        "model", "slice", F.lit("sentence_accuracy").alias("metric"), F.col("sentence_accuracy").alias("value")
    )
    model, base = (both.filter(F.col("model") == m).drop("model") for m in ("ones", "rule"))
    return C.model_deltas(model, base, "slice")


@query("agg_score_rules")
def score_rules(spark, sf):
    """The rule normalizer on the generated test and hard rows, per split."""
    from ..functions.scanning import normalize
    from ..operators.prefix import durable

    rows = durable(_splits(spark, sf).filter(F.col("split").isin("test", "hard")))
    predicted = rows.withColumn("pred", normalize(F.col("before"))).withColumn("correct", F.col("pred") == F.col("after"))
    return C.score(predicted, "split")


def _train_and_hard(spark, sf):
    from ..operators.prefix import durable

    wanted = _splits(spark, sf).filter("split in ('train', 'test', 'hard') and classes[0] != 'REAL'")
    # Pool and hard rows come from the same ids; the key must tell them apart.
    rows = durable(wanted.withColumn("pair_id", F.col("pair_id") * 2 + (F.col("split") == "hard").cast("int")))
    return rows.filter("split = 'train'"), rows.filter("split != 'train'")


@query("op_context_reader")
def context_reader(spark, sf):
    """Fit on train; rules and reader scored on the test and hard rows."""
    from ..functions.scanning import normalize
    from ..operators import reader as R

    train, held = _train_and_hard(spark, sf)
    said = R.read_in_context(R.fit_reader(train), held)
    reader = C.score(C.join_pred_gold(held, said), "split").withColumn("model", F.lit("reader"))
    rules = held.select("pair_id", normalize(F.col("before")).alias("text"))
    return C.score(C.join_pred_gold(held, rules), "split").withColumn("model", F.lit("rules")).unionByName(reader)


@query("op_tune_reader")
def tune_reader(spark, sf):
    from ..operators import reader as R

    return R.tune_reader(_train_and_hard(spark, sf)[0], [0.0001, 0.001, 0.1])
