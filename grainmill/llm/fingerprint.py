"""Document fingerprints: an exact digest of the canonical text, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_index
from .common import cut_lineage, fresh, release, shuffle_partitions

#: White space of Unicode, as a class of Java patterns.
_WS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: Static methods of the ICU library that Spark itself ships for its collations.
_NORMALIZER, _CHARACTERS = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    """NFC, case folding, NFC again, runs of white space as one space, none at the ends. Null is the empty text."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    composed = F.java_method(F.lit(_NORMALIZER), F.lit("compose"), text, F.lit(False))
    folded = F.java_method(F.lit(_NORMALIZER), F.lit("compose"), F.java_method(F.lit(_CHARACTERS), F.lit("foldCase"), composed, F.lit(True)), F.lit(False))
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), _WS, " "))


def digest(canon: Column) -> Column:
    """128 bits: two xxHash64 values with different seeds, in hexadecimal."""
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(half(1), half(2))


def with_next(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Key, text, its digest and tie-breaker, and text and digest of the next row in ascending order of the key (after the last, the first).

    Rows are dealt to blocks between quantiles of the key, which must be a number; the first row of each block also goes to the
    block before it, so the texts move once and no task holds more than a block. Null keys come first; rows with equal keys are
    ordered by their texts, and all of one key are in one block.
    """
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double") and not df.schema[key].dataType.typeName().startswith("decimal"):
        raise TypeError(f"the key must be a number, to be in order: {key}")
    rows = df.select(df[key].alias("key"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("canon", canonical(F.col("text"))).withColumns({"fp": digest(F.col("canon")), "tp": _tie("canon")}).drop("canon")
    blocks = 4 * shuffle_partitions(df.sparkSession)
    cuts = df.agg(F.percentile_approx(df[key], [i / blocks for i in range(1, blocks)], 20 * blocks).alias("c")).first()["c"]
    block = range_index(F.col("key"), sorted(set(cuts or [])))
    dealt = rows.withColumn("block", block.cast("int"))
    # of each block, its least row; of these, the block before it. As many rows as there are blocks.
    least = df.select(df[key].alias("key")).withColumn("block", block.cast("int")).groupBy("block").agg(
        F.min(F.coalesce(F.struct(F.col("key").isNotNull().alias("known"), F.col("key").alias("k")), F.lit(None))).alias("least"))
    one = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("block").over(one.orderBy("block")), F.max("block").over(one))
    least = least.select(F.col("block").alias("b"), F.col("least.k").alias("first_key"), before.alias("before"), (F.col("block") == F.min("block").over(one)).alias("wraps"))
    joined = dealt.join(F.broadcast(least), dealt["block"] == least["b"])  # proven size: one row for each block
    first = F.col("key").eqNullSafe(F.col("first_key"))
    copies = F.when(first, F.array(F.struct(F.col("block").alias("at"), F.lit(0).alias("late")), F.struct(F.col("before").alias("at"), F.lit(1).alias("late")))).otherwise(F.array(F.struct(F.col("block").alias("at"), F.lit(0).alias("late"))))
    spread = joined.select("key", "text", "fp", "tp", F.explode(copies).alias("c")).select("key", "text", "fp", "tp", "c.at", "c.late")
    # A guest is the first row of the block after this one (or, in the last block, of the first): it stands last.
    order = Window.partitionBy("at").orderBy("late", F.col("key").asc_nulls_first(), "text")
    return spread.select("key", "text", "fp", "tp", "late", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")).where("late = 0").drop("late")


def _tie(canon: str) -> Column:
    return F.substring(F.sha2(canon, 256), 1, 16)


def _forms(rows: DataFrame) -> DataFrame:
    """One row for each digest: how many canonical texts have it, and the tie-breaker of one of them.

    Grouping by digest and canonical text compares the texts of equal digests byte by byte; copies are summed up before
    the shuffle, which moves each text once for every task that holds it.
    """
    kinds = rows.groupBy("fp", "canon").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"), F.min(_tie("canon")).alias("tie")).drop("canon")
    return cut_lineage(kinds.groupBy("fp").agg(F.count(F.lit(1)).alias("forms"), F.min("tie").alias("only")))


def _rows(df: DataFrame, text_col: str, key: str) -> DataFrame:
    return df.select(df[key].alias("key"), canonical(F.coalesce(df[text_col], F.lit(""))).alias("canon")).withColumn("fp", digest(F.col("canon")))


def _named(rows: DataFrame, forms: DataFrame, fp: str, tie: str, name: str) -> DataFrame:
    """Adds the fingerprint: the digest, with the tie-breaker if other texts share the digest."""
    own = forms.select(fresh("fp").alias("_fp"), F.col("forms").alias("_forms"), F.col("only").alias("_only"))
    apart = (F.col("_forms") > 1) | (F.col("_only") != F.col(tie))
    return rows.join(own, F.col(fp) == F.col("_fp"), "left").withColumn(name, F.when(apart, F.concat(fp, tie)).otherwise(F.col(fp))).drop("_fp", "_forms", "_only")


def fingerprints(df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprint each whole text and say which rows share it.

    Returns key, fingerprint (32 hexadecimal digits), ``class_id`` (least key with the same fingerprint) and ``copies``.
    Two texts whose digests agree by chance stay apart: their fingerprints get 16 more digits from SHA-256. Texts that
    differ in case, white space or normalisation only are equal; null is the empty text; texts count whole, however long. Repeated
    rows and ties count as copies; an empty table gives an empty result; further columns are not passed on, whatever their names.
    """
    rows = _rows(df, text_col, key)
    named = _named(rows.select("key", "fp", _tie("canon").alias("tie")), _forms(rows), "fp", "tie", "fingerprint")
    named = cut_lineage(named)
    classes = cut_lineage(named.groupBy("fingerprint").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("copies")))
    classes = classes.select(fresh("fingerprint").alias("_class"), "class_id", "copies")
    return named.join(classes, F.col("fingerprint") == F.col("_class")).select(F.col("key").alias(key), "fingerprint", "class_id", "copies")


def fingerprint_edits(df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to it and to the next document.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next document. The
    digest is exact, so likeness is 1 for equal canonical texts and 0 otherwise; equal digests are confirmed by comparing
    the canonical texts. A single row is its own next document; an empty table gives an empty result. Nulls, ties and
    repeated rows are as in ``with_next`` and ``fingerprints``.
    """
    forms = _forms(_rows(df, text_col, key))
    release(df.sparkSession)
    pairs = with_next(df, key, text_col).withColumn("n_chars", F.length("text").cast("long"))
    pairs = pairs.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) div 4 as int))"), F.expr("substring(next_text, 1, cast(length(text) div 4 as int))")))
    pairs = pairs.select("key", "text", "next_text", "n_chars", "fp", "tp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("edited")).alias("ce"))
    pairs = pairs.withColumn("fe", digest(F.col("ce")))
    # equal digests, and only they, have their canonical texts compared
    alike = lambda d, c: F.when(F.col("fp") == F.col(d), canonical(F.col("text")) == c()).otherwise(F.lit(False)).cast("double")
    narrow = pairs.select("key", "n_chars", "edited_sha256", "fp", "tp", "fe", _tie("ce").alias("te"), alike("fe", lambda: F.col("ce")).alias("near_edited"), alike("next_fp", lambda: canonical(F.col("next_text"))).alias("near_next"))
    several = forms.where("forms > 1")  # hardly ever any
    named = narrow.withColumn("fingerprint", F.col("fp")) if several.isEmpty() else _named(narrow, several, "fp", "tp", "fingerprint")
    named = _named(named, forms, "fe", "te", "edited_fingerprint")
    return named.select(F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
