"""SpotSigs fingerprints with DataFrame functions only.

A signature is a common word (the anchor) and the chain of content words that
follows it; a document's fingerprint is its set of signatures, hashed. Running
text has many anchors, navigation and junk few, so the set reflects the prose.
Documents are compared by the Jaccard likeness of their sets; candidates share
a rare signature and lie in matching partitions of set length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Anchors, and with them the common words that chains skip.
ANCHORS = (
    "the is was of and to in that for with "
    "le la les des et est dans pour une qui "
    "der die das und ist den von mit ein zu "
    "el los las que del una por con es y"
).split()
COMMON = (
    "a an are be it on as by at this from or not he she they we you i his her its but have has had were been will would can "
    "un du de en que sur au aux ce se il elle ils ne pas par avec son sa ses "
    "dem des eine einer eines im auf für nicht sich auch als an es er sie wir ihr wird sind war "
    "lo al se su sus no como más pero para"
).split()
CHAIN = 2
#: Words after the anchor among which its chain lies.
REACH = 8
NEAR = 0.8
#: Rows of a window when neighbours in doc_id order are looked up, and windows at most.
WINDOW_ROWS, WINDOWS = 2000, 20_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN, reach: int = REACH) -> DataFrame:
    """Adds ``out``: the sorted set of signatures of ``text`` as array<bigint>.

    A text without an anchor that has a whole chain gets one signature, the hash
    of the text itself, so only equal ones among such texts are alike. Null
    counts as the empty text.
    """
    w, at = f"{out}_words", f"{out}_at"
    stop = [*ANCHORS, *COMMON]
    link = lambda i: F.slice(F.filter(F.slice(w, i + 1, reach), lambda x: ~x.isin(stop)), 1, chain)
    return (
        df.withColumn(w, words(F.coalesce(text, F.lit(""))))
        .withColumn(at, F.filter(F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(w, i).isin(ANCHORS)))
        .withColumn(out, F.transform(at, lambda i: F.struct(F.element_at(w, i).alias("a"), link(i).alias("c"))))
        .withColumn(out, F.transform(F.filter(out, lambda s: F.size(s["c"]) == chain), lambda s: F.xxhash64(s["a"], F.array_join(s["c"], " "))))
        .withColumn(out, F.array_sort(F.array_distinct(out)))
        .withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(F.array(F.xxhash64(F.coalesce(text, F.lit(""))))))
        .drop(w, at)
    )


def fingerprint(signatures: str) -> Column:
    """The set as text: sorted hexadecimal signatures, comma-joined."""
    return F.lower(F.array_join(F.transform(signatures, lambda x: F.hex(x)), ","))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_next(df: DataFrame, order: str, columns: list[str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Adds ``next_<column>`` of the next row in ascending ``order`` (integer); after the last comes the first.

    Rows are cut into ranges of ``order`` so that no window holds them all. The
    first row of each range also goes to the range before it, where it is the
    neighbour of that range's last row. Nulls come first; equal ids are ordered
    by the columns.
    """
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))
    ids = df.select(key.alias("k"))
    n = ids.count()
    ranges = min(WINDOWS, -(-n // window_rows))
    splits: list[int] = []
    if ranges > 1:
        found = ids.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
        splits = sorted(set(found))
    # Number of splits at or below the key, by binary search.
    steps = [1 << i for i in reversed(range(len(splits).bit_length()))]
    held = F.array(*map(F.lit, splits)) if splits else F.array(F.lit(0).cast("long"))
    bucket = F.aggregate(F.array(*map(F.lit, steps or [1])), F.lit(0), lambda p, s: F.when((p + s <= len(splits)) & (F.try_element_at(held, F.when(p + s <= len(splits), p + s).otherwise(1)) <= F.col("_k")), p + s).otherwise(p))
    rows = df.withColumn("_k", key).withColumn("_b", bucket)
    # One number for each range.
    firsts = {r["_b"]: r["k"] for r in rows.groupBy("_b").agg(F.min("_k").alias("k")).collect()}
    full = sorted(firsts)
    if not full:
        return df.withColumns({f"next_{c}": F.col(c) for c in columns})
    before = {b: full[i - 1] for i, b in enumerate(full)}
    size = full[-1] + 1
    first_of = F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(size)])
    to = F.array(*[F.lit(before.get(b, -1)) for b in range(size)])
    is_first = F.col("_k") == F.element_at(first_of, F.col("_b") + 1)
    home = F.struct(F.col("_b").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.element_at(to, F.col("_b") + 1).alias("b"), F.when(F.col("_b") == full[0], 2).otherwise(1).alias("guest"))
    dealt = rows.withColumn("_to", F.explode(F.when(is_first, F.array(home, guest)).otherwise(F.array(home))))
    by = Window.partitionBy("_to.b").orderBy("_to.guest", "_k", *columns)
    led = dealt.withColumns({f"next_{c}": F.lead(c).over(by) for c in columns})
    return led.where(F.col("_to.guest") == 0).drop("_k", "_b", "_to")


def compare_edited(df: DataFrame) -> DataFrame:
    """Fingerprints each text and its edited text, and compares with both neighbours.

    ``df(doc_id, text)``; the edited text has its last floor(n/2) code points
    replaced by the first as many (or all) of the next document's. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. Null text counts as empty; other columns are not
    read; repeated rows are each other's next; an empty table stays empty.
    """
    rows = with_signatures(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sig")
    rows = with_next(rows, "doc_id", ["text", "sig"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))}).drop("text", "next_text")
    rows = with_signatures(rows, "edited", "edited_sig")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("sig").alias("fingerprint"),
        fingerprint("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )


def near_duplicates(df: DataFrame, threshold: float = NEAR) -> DataFrame:
    """Pairs (a, b, likeness) of class representatives with likeness of at least ``threshold``.

    Rows with equal sets form a class, named by its smallest doc_id. Sets are
    dealt to partitions of length so narrow that a set can only match its own
    and the next one; there, two sets that match share one of the rarest
    signatures of each (the first ``n - ceil(threshold * n) + 1`` in order of
    frequency). Pairs whose lengths rule the threshold out are never compared.
    Rows of null doc_id are left out.
    """
    sets = with_signatures(df.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), "text", "sig").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    sets = sets.withColumns({"n": F.size("sig"), "part": F.floor(F.log(F.size("sig").cast("double")) / -math.log(threshold)).cast("int")})
    tokens = sets.select("doc_id", "n", "part", F.explode("sig").alias("s"))
    often = tokens.groupBy("s").agg(F.count("*").alias("f"))
    ranked = tokens.join(often, "s").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("f", "s")))
    rare = ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("f") > 1)).select("doc_id", "n", "part", "s")
    left = rare.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "s")
    right = rare.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "part", "s")
    pairs = left.join(right, ["part", "s"]).where(((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= F.col("nb") * threshold)).select("a", "b").distinct()
    full = sets.select("doc_id", "sig")
    joined = pairs.join(full.withColumnsRenamed({"doc_id": "a", "sig": "sa"}), "a").join(full.withColumnsRenamed({"doc_id": "b", "sig": "sb"}), "b")
    return joined.withColumn("likeness", likeness("sa", "sb")).where(F.col("likeness") >= threshold).select("a", "b", "likeness")
