"""Personal data by bootstrapped contextual extraction.

Identifiers of fixed forms are the seeds. The words on either side of them and their own spelling induce lexical patterns;
Spark scores the graph of patterns and instances in rounds, and the patterns that are left with high confidence discover
identifiers that the fixed forms miss, which are seeds of the next round.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _C1, _C2, _powers, cut_lineage, mix, tidy

#: Kinds in the order that breaks ties of start.
KINDS = ("email", "ip", "card", "phone")
# The forms of the base spans.
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")  # no start within a run
_EMAIL_LATER = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN_HINT = re.compile(r"[0-9@]|[(\[_][Aa][Tt][)\]_]")
# Written-out addresses and groups of digits, with spaces.
_AT = re.compile(r"(?i)[(\[{<] ?at ?[)\]}>]|(?<=[ \t])at(?=[ \t])")
_DOT = r"(?:[ \t]{0,2}[(\[{<] ?dot ?[)\]}>][ \t]{0,2}|[ \t]{1,2}dot[ \t]{1,2})"
_DOMAIN = re.compile(rf"(?i)[ \t]{{0,2}}[a-z0-9-]++(?:(?:\.|{_DOT})[a-z0-9-]++)+")
_DOTTED = re.compile(rf"(?i)[ \t]{{1,2}}[a-z0-9-]++(?:\.[a-z0-9-]++)*{_DOT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)*")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_GROUP = re.compile(r"[(\[]?\+?[0-9][0-9.()/-]*\]?")
_NEXT_GROUP = re.compile(r"[ \t\xa0]{1,2}(?:[-/] )?[(\[]?[0-9](?:[.()/-]*[0-9)])*(?![^\s\"')\]}>.,;:!?])")
_TRIM = "\"'()[]{}<>.,;:!?*#$%&="
#: A pattern must have been seen with this many different seeds, and reach this confidence.
SUPPORT, CONFIDENCE = 3, 0.8
#: Rounds of the bootstrap at most; it ends as soon as a round has the same sure tokens as the one before.
ROUNDS = 10


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time that grows with the text's length only.

    All starts within a run of local characters reach the same @, so its first one decides. An address may end within a
    run; what is left of that run is the one start that follows no other character.
    """
    at = 0
    while m := _EMAIL_LATER.match(text, at) or _EMAIL.search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, leftmost and non-overlapping in each kind, by start and then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _HINT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def shape_fits(token: str) -> int:
    """The kinds that a token without a fixed form may be, as bits: what a pattern may discover."""
    digits, letters = sum("0" <= c <= "9" for c in token), sum(c.isalpha() for c in token)
    low = token.lower()
    bits = 1 * (letters >= 3 and any(a in low for a in ("@", "[at]", "(at)", "_at_")))
    bits |= 2 * (digits >= 4 and not letters and sum(token.count(c) for c in ".:-_,") >= 3)
    bits |= 4 * (12 <= digits <= 19 and letters == 0)
    bits |= 8 * (7 <= digits <= 15 and letters == 0)
    return bits


_GAPS = np.zeros(0x3002, dtype=bool)
_GAPS[[c for c in range(0x3002) if chr(c).isspace()]] = True
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]")
#: What a pattern is made of; the number keeps equal words in different roles apart. The last bit of a pattern's hash tells the
#: two views: 0 for the words beside an identifier, 1 for its own spelling.
BEFORE, BEFORE_TWO, AFTER, AFTER_TWO, AROUND, SPELLING, OUTLINE, TAIL = range(1, 9)


def _tagged(role: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), role, dtype=np.uint64) * _C2
    for p in parts:
        h = mix(h * _C1 + p)
    return (h & ~np.uint64(1)).view(np.int64)


def _text_hash(role: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{role} {text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) | 1


def spellings(token: str) -> list[int]:
    """Patterns of an identifier's own spelling: digits and runs of letters as signs; the same with runs of digits as one, if
    that says more than that it is a number; and the last two labels after an @. As many digits as a card has count as another
    spelling where their check digit is right."""
    shape = _DIGITS.sub("9", _LETTERS.sub("a", token))
    outline = re.sub("9+", "9", shape)
    if shape_fits(token) & 4 and _luhn("".join(_DIGITS.findall(token))):
        shape, outline = shape + " checked", outline + " checked"
    out = [_text_hash(SPELLING, shape)]
    if len(outline) > 1:
        out.append(_text_hash(OUTLINE, outline))
    if "@" in token:
        out.append(_text_hash(TAIL, ".".join(token.rpartition("@")[2].lower().rsplit(".", 2)[-2:])))
    return out


def contexts(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Patterns of the words beside each span, on the same line: one or two before, one or two after, one on either side.

    Words are whole, however long, and end at a span that they touch. Prefix sums give the hash of any stretch of the text, so
    the time grows with the text and the number of spans only. A-Z count as a-z.
    """
    if not spans:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(codes)
    gap = _GAPS[np.minimum(codes, 0x3001)]
    edge = np.diff(np.concatenate(([True], gap, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lines = np.flatnonzero(codes == 10)
    low = codes.astype(np.uint64) + ((codes >= 65) & (codes <= 90)).astype(np.uint64) * np.uint64(32)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(low * _C1 + np.uint64(1)) * power[:n], out=sums[1:])

    def stretch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * _C1)

    a, b = (np.array(x, dtype=np.int64) for x in zip(*spans, strict=True))
    line = lambda x: np.searchsorted(lines, x)
    pick = lambda table, i: table[np.clip(i, 0, len(table) - 1)]
    i, j = np.searchsorted(starts, a) - 1, np.searchsorted(ends, b, "right")
    there = [(i - k >= 0) & (line(pick(starts, i - k)) == line(a)) for k in (0, 1)] + [(j + k < len(ends)) & (line(pick(starts, j + k)) == line(b)) for k in (0, 1)]
    zero = np.zeros_like(a)
    safe = lambda ok, x, y: stretch(np.where(ok, x, zero), np.where(ok, y, zero))
    left, left2 = safe(there[0], pick(starts, i), np.minimum(pick(ends, i), a)), safe(there[1], pick(starts, i - 1), pick(ends, i - 1))
    right, right2 = safe(there[2], np.maximum(pick(starts, j), b), pick(ends, j)), safe(there[3], pick(starts, j + 1), pick(ends, j + 1))
    kinds = ((there[0], _tagged(BEFORE, left)), (there[1], _tagged(BEFORE_TWO, left2, left)), (there[2], _tagged(AFTER, right)), (there[3], _tagged(AFTER_TWO, right, right2)), (there[0] & there[2], _tagged(AROUND, left, right)))
    return [[int(h[k]) for ok, h in kinds if ok[k]] for k in range(len(spans))]


def _instance(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _written(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a written-out at that stands between spaces: with brackets, or bare and followed by a written dot."""
    at = 0
    while m := _AT.search(text, at):
        start, at = m.start(), m.end()
        while start > 0 and m.start() - start < 2 and text[start - 1] in " \t":
            start -= 1
        first = start
        while first > 0 and text[first - 1] in _LOCAL:  # the token before, whole: no two written ats share one
            first -= 1
        if d := (_DOMAIN if m.group()[0] not in "Aa" else _DOTTED).match(text, m.end()):
            if first < start and any(c in " \t" for c in text[first : d.end()]):
                yield first, d.end()
                at = d.end()


def _groups(text: str, start: int, end: int, free: int) -> int:
    """The end of the longest run of digit groups from the token at ``start``, up to ``free``, that fits a kind; 0 if none."""
    digits, stops = sum("0" <= c <= "9" for c in text[start:end]), [end]
    while digits <= 19 and (m := _NEXT_GROUP.match(text, stops[-1])) and m.end() <= free:
        stops.append(m.end())
        digits += sum("0" <= c <= "9" for c in m.group())
    return next((stop for stop in reversed(stops[1:]) if shape_fits(text[start:stop])), 0)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds as bits) of tokens with digits or a written @ outside the base spans.

    A token of digits that fits no kind is taken with the digit groups that follow it, as many as fit a kind together;
    written-out addresses are one candidate with their spaces.
    """
    out, at = [], 0
    starts, reach = [a for a, _, _ in spans], list(accumulate((b for *_, b in spans), max, initial=0))
    written = [(a, b) for a, b in _written(text) if reach[bisect_left(starts, b)] <= a]
    out += [(a, b, 1) for a, b in written]
    inside = [a for a, _ in written]
    while m := _TOKEN_HINT.search(text, at):
        start, end = m.start(), m.end()
        while start and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        at, left, right = end, start, end
        while start < end and text[start] in _TRIM:
            start += 1
        while end > start and text[end - 1] in _TRIM:
            end -= 1
        k = bisect_left(inside, end)
        if start < end and reach[bisect_left(starts, end)] <= start and not (k and written[k - 1][1] > start):
            bits = shape_fits(text[start:end])
            if not bits and _GROUP.fullmatch(text, left, right):
                after = bisect_left(starts, end)
                if stop := _groups(text, left, right, starts[after] if after < len(starts) else len(text)):
                    start, end, at = left, stop, stop  # the groups are one identifier
                    bits = shape_fits(text[start:end])
            out.append((start, end, bits))
    return sorted(out)


_SCAN = ("key {}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base array<struct<start:int,kind:int,stop:int>>, base_sha256 string, digest string, seeds array<struct<kind:int,instance:bigint,contexts:array<bigint>>>, "
         "found array<struct<start:int,stop:int,fits:int,instance:bigint,contexts:array<bigint>>>")
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
_SEEDS = pa.list_(pa.struct([("kind", pa.int32()), ("instance", pa.int64()), ("contexts", pa.list_(pa.int64()))]))
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("fits", pa.int32()), ("instance", pa.int64()), ("contexts", pa.list_(pa.int64()))]))


def scan(df: DataFrame, text_col: str = "text", key: str = "doc_id", hide: int = 0) -> DataFrame:
    """One pass over the texts: base spans, the patterns around the seeds, and the tokens that patterns may discover.

    ``digest`` is the MD5 of texts with such a token. For measurements, base spans whose number as an instance ``hide`` divides
    are no seeds but candidates, as if no fixed form had found them; what is returned as base is the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base, sha, digest, seeds, found = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in spans))
                base.append([{"start": a, "kind": k, "stop": b} for a, k, b in spans])
                sha.append(hashlib.sha256(render(spans).encode()).hexdigest())
                shown = [s for s in spans if not hide or _instance(text[s[0] : s[2]]) % hide]
                loose = candidates(text, shown)
                near = contexts(text, [(a, b) for a, _, b in shown] + [(a, b) for a, b, _ in loose])
                seeds.append([{"kind": k, "instance": _instance(text[a:b]), "contexts": near[i] + spellings(text[a:b])} for i, (a, k, b) in enumerate(shown)])
                found.append([{"start": a, "stop": b, "fits": bits, "instance": _instance(text[a:b]), "contexts": near[len(shown) + i] + spellings(text[a:b])} for i, (a, b, bits) in enumerate(loose)])
                digest.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest() if any(bits for *_, bits in loose) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, _BASE), pa.array(sha, pa.string()), pa.array(digest, pa.string()), pa.array(seeds, _SEEDS), pa.array(found, _FOUND)],
                names=["key", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "digest", "seeds", "found"])

    return df.select(df[key], df[text_col]).mapInArrow(tidy(run), _SCAN.format(df.schema[key].dataType.simpleString()))


def score_patterns(scanned: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Confidence of each pattern (context, kind) with at least ``support`` different seeds.

    In each round a pattern's confidence is the mean score of the tokens it goes with, seeds of its kind being 1, seeds
    of another kind 0 and other tokens what the best pattern of the other view gave them in the round before: spellings are
    judged by the words beside them and words by spellings, so that no pattern confirms itself. Tokens that reach
    ``confidence`` by either view are seeds in the next round, wherever they stand, and induce new patterns there. The rounds end
    when these tokens stay the same. Everything is summed up by (context, instance) before it is joined.
    """
    seeds = scanned.select(F.explode("seeds").alias("s")).select("s.kind", "s.instance", F.explode("s.contexts").alias("context")).groupBy("context", "kind", "instance").agg(F.count(F.lit(1)).alias("n"))
    others = scanned.select(F.explode("found").alias("f")).select("f.fits", "f.instance", F.explode("f.contexts").alias("context")).groupBy("context", "instance", "fits").agg(F.count(F.lit(1)).alias("n"))
    seeds, others = cut_lineage(seeds), cut_lineage(others)
    met = cut_lineage(seeds.select("context", "n").union(others.select("context", "n")).groupBy("context").agg(F.sum("n").alias("met")))
    view = F.col("context").bitwiseAND(F.lit(1)).alias("view")
    known, scored, mark = seeds, None, (0, None)
    for k in range(rounds):
        if k:
            edges = others.where("fits > 0").join(scored.select("context", "kind", "confidence"), "context").where(F.expr("shiftright(fits, kind) & 1 = 1"))
            best = cut_lineage(edges.groupBy("instance", "kind", view).agg(F.max("confidence").alias("score")))
            sure = cut_lineage(best.where(F.col("score") >= confidence).groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")))
            before, mark = mark, tuple(sure.agg(F.count(F.lit(1)), F.sum(F.xxhash64("instance", "kind").cast("decimal(38,0)"))).first())
            if k > 1 and mark == before:
                break
            known = seeds.union(others.join(sure, "instance").select("context", "kind", "instance", "n"))
            other_view = best.select("instance", "kind", (1 - F.col("view")).alias("view"), "score")
            lent = edges.withColumn("view", view).join(other_view, ["instance", "kind", "view"]).join(sure.select("instance"), "instance", "left_anti").groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("lent"))
        patterns = known.groupBy("context", "kind", "instance").agg(F.sum("n").alias("n")).groupBy("context", "kind").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("own")).where(F.col("support") >= support)
        patterns = patterns.join(met, "context")
        patterns = patterns.join(lent, ["context", "kind"], "left") if k else patterns.withColumn("lent", F.lit(0.0))
        scored = cut_lineage(patterns.select("context", "kind", "support", ((F.col("own") + F.coalesce("lent", F.lit(0.0))) / F.col("met")).alias("confidence")))
    return scored


def extract(df: DataFrame, text_col: str = "text", key: str = "doc_id", rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, hide: int = 0) -> DataFrame:
    """Personal data in every whole text.

    Returns key, n_email, n_ip, n_card, n_phone and base_sha256 (of the base spans), ``spans``: an array of
    (start, kind, stop, discovered) by start and then kind, ends exclusive, in code points; and ``digest``, the MD5 of texts in
    which something may have been discovered. Discovered spans never replace base ones, overlap none of them, and must have a
    shape that their kind may have; of several patterns the most confident names the kind, of equally confident ones the kind
    listed first. Of overlapping discoveries those that begin first stay, of these the longest.

    Null texts are empty. What is discovered in a text depends on the text and on all patterns, so equal texts have equal spans,
    whatever their keys: repeated rows, repeated and null keys need no care. Long texts and words are taken as a whole. An empty
    table gives an empty result; further columns are not passed on, whatever their names.
    """
    scanned = cut_lineage(scan(df, text_col, key, hide))
    good = score_patterns(scanned, rounds, support, confidence).where(F.col("confidence") >= confidence)
    held = scanned.where("digest is not null")
    tokens = held.select("digest", F.explode("found").alias("f")).select("digest", "f.start", "f.stop", "f.fits", F.explode("f.contexts").alias("context")).where("fits > 0").distinct()  # copies are summed up here
    hits = tokens.join(good, "context").where(F.expr("shiftright(fits, kind) & 1 = 1")).groupBy("digest", "start", "stop").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    earlier = F.max("stop").over(Window.partitionBy("digest").orderBy("start", F.col("stop").desc()).rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("earlier", earlier).where("earlier is null or stop > earlier")
    new = cut_lineage(hits.groupBy("digest").agg(F.collect_list(F.struct("start", "kind", "stop", F.lit(True).alias("discovered"))).alias("new")))
    kind = "array<struct<start:int,kind:int,stop:int,discovered:boolean>>"
    joined = held.join(new.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left").drop("_digest")
    both = joined.unionByName(scanned.where("digest is null").withColumn("new", F.lit(None).cast(kind)))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.lit(False).alias("discovered")))
    spans = F.array_sort(F.concat(base, F.coalesce("new", F.array().cast(kind))))
    return both.select(F.col("key").alias(key), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), "digest")


def spans_string(spans: str = "spans"):
    """The spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def redact(df: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with each span of ``found`` replaced by its kind in angle brackets; overlaps become one.

    Base spans are found again in the text itself; only texts with discovered spans need theirs from ``found``, by digest.
    """
    own = F.transform(F.filter("spans", lambda s: s["discovered"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    new = found.where(F.exists("spans", lambda s: s["discovered"])).select(F.col("digest").alias("_digest"), own.alias("_new")).dropDuplicates(["_digest"])
    names = df.columns
    joined = df.join(cut_lineage(new), F.md5(df[text_col]) == F.col("_digest"), "left").select(*[df[c] for c in names], "_new")
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, more in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if text is not None:
                    spans = sorted(base_spans(text) + [(s["start"], s["kind"], s["stop"]) for s in more or []])
                    parts, at = [], 0
                    for a, k, b in spans:
                        if a >= at:
                            parts += [text[at:a], f"<{KINDS[k]}>"]
                        at = max(at, b)
                    text = "".join(parts) + text[at:] if spans else text
                out.append(text)
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(tidy(run), df.schema)
