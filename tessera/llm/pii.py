"""Personal data: base patterns, then bootstrapped contextual extraction. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._store import discard, few_files, stored

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Runs are possessive and begin where the run begins, so time stays linear; matches are the same, but for
#: cards of fewer than 13 digits, which would fail.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A maximal run of identifier characters with an at sign, or of digits, points and hyphens: what a learned pattern may extract.
CANDIDATE = r"(?<![A-Za-z0-9@._%+-])(?:[A-Za-z0-9._%+-]++@[A-Za-z0-9._%+-]++|\+?+[0-9][0-9.-]{5,}+)(?![A-Za-z0-9@._%+-])"
#: A maximal run of digits over the separators of phones and cards, which a learned pattern of those may extract too.
RUN = r"(?:\((?=[0-9+])|(?<![A-Za-z0-9@._%+-]))\+?[0-9](?:[\x20().-]*+[0-9]){6,}+"
#: Cheap tests a text passes if a pattern can match in it.
NEEDS = {"email": "[@]", "ip": "[0-9]", "card": "[0-9]", "phone": "[+]", "cand": "[0-9@]", "runs": "[0-9]"}
#: What a candidate must look like to be of a kind.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
    "card": r"^[0-9][0-9-]{11,22}[0-9]$|^(?:[0-9][\x20-]?){12,18}[0-9]$",
    "phone": r"^\+?[0-9][0-9.-]{5,17}[0-9]$|^\(?\+?(?:[0-9][\x20().-]*+){6,14}[0-9]$",
}
CONTEXT_CHARS = 48
ROUNDS = 4
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.9
SALTS = 32


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15)


def _check(kind: str):
    return lambda s: _valid(kind, s["m"])


def prefix_sums(steps: Column) -> Column:
    """sums[i] = steps[0] + .. + steps[i-1], in two levels, so that n entries take about n**1.5 additions."""
    n = F.size(steps)
    width = F.ceil(F.sqrt(n + 1)).cast("int")
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    index = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    block_sums = F.transform(F.sequence(F.lit(0), F.floor(n / width).cast("int")), lambda b: add(F.slice(steps, b * width + 1, width)))
    packed = F.struct(steps.alias("s"), block_sums.alias("b"), width.alias("w"), index.alias("i"))
    return F.transform(
        F.array(packed),
        lambda p: F.transform(
            p["i"], lambda i: F.aggregate(F.slice(p["b"], 1, F.floor(i / p["w"]).cast("int")), F.lit(0), lambda s, x: s + x)
            + F.aggregate(F.slice(p["s"], (F.floor(i / p["w"]) * p["w"] + 1).cast("int"), (i % p["w"]).cast("int")), F.lit(0), lambda s, x: s + x)
        ),
    )[0]


BEGIN, END = "\u0001", "\u0002"


def matches(df: DataFrame, text: str, pattern: str, some: Column) -> DataFrame:
    """Add ``_p``, the pieces between matches, one more than matches, and ``_m``, the matches; null unless ``some``.

    One pass of the pattern marks the matches; the marks can't stand in the text, where they are replaced before by a
    character of the same width that no pattern knows either.
    """
    marked = F.regexp_replace(F.translate(F.col(text), BEGIN + END, "\u0003\u0003"), pattern, f"{BEGIN}$0{END}")
    df = df.withColumn("_x", F.when(some, F.split(marked, BEGIN, -1)))
    df = df.withColumn("_m", F.transform(F.slice("_x", 2, F.greatest(F.size("_x") - 1, F.lit(0))), lambda x: F.substring_index(x, END, 1)))
    rest = F.zip_with(F.slice("_x", 2, F.greatest(F.size("_x") - 1, F.lit(0))), F.col("_m"), lambda x, m: F.substring(x, F.length(m) + 2, F.length(x)))
    return df.withColumn("_p", F.concat(F.slice("_x", 1, 1), rest)).drop("_x")


def positioned(df: DataFrame, text: str, pattern: str, name: str, needs: str = ".") -> DataFrame:
    """Add ``name``: array of (start, end, m, left, right) of all matches, in code points; null where ``needs`` isn't found.

    ``left`` and ``right`` are the ``CONTEXT_CHARS`` of the text before and after a match, whatever matches stand in them.
    """
    some = F.col(text).rlike(needs)
    df = matches(df, text, pattern, some)
    df = df.withColumn("_l", F.transform("_p", lambda p: F.length(p))).withColumn("_k", F.transform("_m", lambda m: F.length(m)))
    near = F.lit(CONTEXT_CHARS)  # so many matches with the pieces between them have as many characters at least
    df = df.withColumn("_a", F.zip_with(F.slice("_p", 1, F.size("_m")), F.col("_m"), lambda p, m: F.concat(F.right(p, near), F.right(m, near))))
    df = df.withColumn("_b", F.zip_with("_m", F.slice("_p", 2, F.size("_m")), lambda m, p: F.concat(F.left(m, near), F.left(p, near))))
    df = df.withColumn("_s", prefix_sums(F.zip_with(F.slice("_l", 1, F.size("_k")), F.col("_k"), lambda a, b: a + b)))
    spans = F.transform(
        F.col("_m"),
        lambda m, i: F.struct(
            (F.col("_s")[i] + F.col("_l")[i]).cast("long").alias("start"),
            (F.col("_s")[i] + F.col("_l")[i] + F.col("_k")[i]).cast("long").alias("end"),
            m.alias("m"),
            F.right(F.concat(F.array_join(F.slice("_a", F.greatest(i - near + 1, F.lit(1)), F.least(i, near)), ""), F.right(F.col("_p")[i], near)), near).alias("left"),
            F.left(F.concat(F.left(F.col("_p")[i + 1], near), F.array_join(F.slice("_b", i + 2, near), "")), near).alias("right"),
        ),
    )
    return df.withColumn(name, F.when(F.size("_m") > 0, spans)).drop("_p", "_m", "_l", "_k", "_s", "_a", "_b")


def _pattern_of(left: Column, right: Column) -> Column:
    """The lexical pattern around an instance: the two words before it and the word after, without marks and case."""
    words = F.regexp_replace(F.lower(left), r"[^\p{L}:=]+", " ")
    before = F.regexp_extract(words, r"(\S+ \S+) ?$", 1)
    before = F.when(before != "", before)
    after = F.regexp_extract(F.regexp_replace(F.lower(right), r"[^\p{L}:=]+", " "), r"^ ?(\S+)", 1)
    return F.concat_ws(" _ ", before, F.when(after != "", after))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans_<kind>``: the base spans (start, end, m, left, right) of each kind."""
    out = docs
    for kind in KINDS:
        out = positioned(out, text, PATTERNS[kind], "_all", NEEDS[kind])
        none = F.array().cast(out.schema["_all"].dataType)
        out = out.withColumn(f"spans_{kind}", F.filter(F.coalesce("_all", none), _check(kind))).drop("_all")
    return out


def learned(instances: DataFrame, size: int, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(kind, pattern) of high confidence, from ``instances`` (kind, pattern, value, seed), about ``size`` rows.

    Edges (kind, pattern, value, seed) are counted once, before anything iterates. Seeds score 1. In each round a pattern's
    confidence is the sum of its values' scores by their number and a tenth, and its support the number of its values that are
    seeds or promoted. With a support of ``min_seeds`` it passes its confidence on: the other values score as their best such
    pattern. With a confidence of ``min_confidence`` as well it is trusted, and its values are promoted: they support other
    patterns from then on, so that a pattern may be reached through discovered values only. No figure ever falls. Pattern
    rows are sent to edges over ``SALTS`` parts of their values, and values over as many parts of their patterns, so neither a
    hot pattern nor a hot value is one task.
    """
    value = F.xxhash64("value")
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(SALTS)).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    edges = instances.where(F.length("pattern") > 0).groupBy("kind", "pattern", value.alias("v")).agg(F.max("seed").alias("seed"))
    edges = few_files(edges.withColumn("by_value", part("v")).withColumn("by_pattern", part("pattern")), size)
    score = edges.withColumn("s", F.when(F.col("seed"), 1.0).otherwise(0.0)).withColumn("supports", F.col("seed"))
    for k in range(rounds):
        conf = F.sum("s") / (F.count("*") + 0.1)
        found = score.groupBy("kind", "pattern").agg(conf.alias("conf"), F.sum(F.col("supports").cast("long")).alias("support"))
        found = found.where(F.col("support") >= min_seeds).select("kind", "pattern", "conf", (F.col("conf") >= min_confidence).alias("trusted"))
        if k + 1 == rounds:
            break
        reach = edges.where(~F.col("seed")).join(found.withColumn("by_value", everywhere), ["kind", "pattern", "by_value"])
        best = reach.groupBy("kind", "v").agg(F.max("conf").alias("conf"), F.max("trusted").alias("promoted")).withColumn("by_pattern", everywhere)
        made = edges.join(best, ["kind", "v", "by_pattern"], "left")
        made = made.withColumn("s", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("conf", F.lit(0.0))))
        made = made.withColumn("supports", F.col("seed") | F.coalesce("promoted", F.lit(False))).drop("conf", "promoted")
        last, score = score, few_files(made, size)
        discard(last)
    trusted = few_files(found.where("trusted").select("kind", "pattern", "conf"), size)
    discard(edges, score)
    return trusted


def extract(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned, n_spans) of every row.

    Base spans are those of ``PATTERNS`` whose check holds, each kind on its own. The bootstrapping adds
    identifier-like strings (``CANDIDATE``, ``RUN``) outside all base spans, of a kind's shape, in a context that a learned pattern
    has; those within a longer one of their kind are left out.
    ``spans`` joins all, ``base_sha256`` digests the base ones; ``n_<kind>`` counts base spans. Null and empty texts have
    none (digest of the empty string). Rows with equal id and text share their spans.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text")).withColumn("did", F.coalesce("doc_id", F.lit(0)))
    found = base_spans(rows)
    found = positioned(found, "text", CANDIDATE, "cand", NEEDS["cand"])
    found = positioned(found, "text", RUN, "runs", NEEDS["runs"]).drop("text")
    spaced = F.filter("runs", lambda r: r["m"].rlike(r"[\x20()]") & ~r["right"].rlike(r"^[A-Za-z0-9@_%+]"))
    none = F.array().cast(found.schema["cand"].dataType)
    found = found.withColumn("cand", F.concat(F.coalesce("cand", none), F.coalesce(spaced, none))).drop("runs")
    found = stored(found)

    def items(spans, kind: str, seed: bool) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(seed).alias("seed"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))

    def fitting(kind: str) -> Column:
        return F.filter("free", lambda c: c["m"].rlike(SHAPES[kind]))

    base = F.concat(*(F.transform(f"spans_{k}", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))) for k in KINDS))
    free = F.filter("cand", lambda c: ~F.exists(base, lambda s: (s["a"] < c["end"]) & (c["start"] < s["b"])))
    listed = found.withColumn("free", free)
    seeds, others = [items(f"spans_{k}", k, True) for k in KINDS], [items(fitting(k), k, False) for k in KINDS]
    rows = listed.select("did", "uid", F.explode(F.concat(*seeds, *others)).alias("x"))
    rows = rows.select("did", "uid", *(f"x.{c}" for c in ("kind", "seed", "start", "end", "value")), _pattern_of(F.col("x.left"), F.col("x.right")).alias("pattern"))
    held = found.agg(F.sum(sum((F.size(f"spans_{k}") for k in KINDS), F.size("cand")))).first()[0] or 0
    instances = few_files(rows.where(F.length("pattern") > 0), held)

    good = learned(instances, held).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    new = instances.where(~F.col("seed")).withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")).join(good, ["kind", "pattern", "salt"])
    before = Window.partitionBy("did", "uid", "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("reach", F.max("end").over(before)).where(F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    added = new.groupBy("did", "uid").agg(F.collect_set(F.struct("kind", "start", "end")).alias("new"))

    number = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    span = lambda kind, s: F.struct(number[kind].alias("k"), s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"))
    of_kind = lambda k: F.transform(f"spans_{k}", lambda s: span(F.lit(k), s))
    base_all = F.concat(*(of_kind(k) for k in KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = found.join(added, ["did", "uid"], "left").withColumn("_base", base_all)
    extra = F.when(F.col("new").isNotNull(), F.transform("new", lambda s: span(s["kind"], s)))
    out = out.withColumn("_all", F.when(F.col("new").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", extra))))
    return out.select(
        "doc_id", *(F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"),
        F.greatest(F.coalesce(F.size("new"), F.lit(0)), F.lit(0)).cast("long").alias("n_learned"), F.size("_all").cast("long").alias("n_spans"),
    )


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
