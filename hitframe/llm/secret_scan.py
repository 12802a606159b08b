"""Secrets in texts, and how many repositories and owners share each candidate. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitframe.session import written

#: Kinds in their order for equal starts, with the patterns that find them (fixed values). ``access`` and ``hex`` have the
#: least length in the pattern: a run that is too short holds no longer one. ``assign`` uses up its match before its value
#: is measured.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
LEAST_VALUE = 6
#: Further candidates: long runs that mix letters of both cases and digits. They are secrets only if few owners have them.
OPAQUE = r"[A-Za-z0-9+/_-]{32,}"
#: Words in values of examples and templates (fixed values).
EXAMPLE = r"(?i)example|sample|changeme|placeholder|dummy|xxxx|your[-_]?|test|1234567|abcdef0"
#: A value that more owners than this have is a widely copied example.
OWNERS = 3

#: Items of an array that are folded together, and a place beyond any text.
CHUNK, FAR = 256, (1 << 31) - 1
SPAN = "struct<start:int,kind_order:int,end:int,kind:string,value:string>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` where ``value`` is worked out once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, first: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For an array of numbers, ``first`` merged with all values up to each.

    A fold that appends copies the array at each step, so values are folded in chunks, after the totals of the chunks.
    """

    def fold(items: Column, start: Column) -> Column:
        return F.aggregate(items, F.array(start), lambda acc, v: F.concat(acc, F.array(merge(F.element_at(acc, -1), v))))

    def totals(chunks: Column) -> Column:
        return fold(F.transform(chunks, lambda c: F.aggregate(c, first, merge)), first)

    def whole(chunks: Column) -> Column:
        return F.flatten(F.zip_with(chunks, F.slice(totals(chunks), 1, F.size(chunks)), lambda c, start: F.slice(fold(c, start), 2, CHUNK)))

    return bound(values, lambda v: bound(chunks_of(v), whole))


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def chunks_of(items: Column) -> Column:
    """An array in arrays of at most ``CHUNK`` items."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, CHUNK))).otherwise(F.array())


def matches(text: Column, pattern: str, kind: str, order: int) -> Column:
    """Leftmost non-overlapping matches as an array of spans (code points, end exclusive).

    Between the matches lie the parts of a split, so lengths add up to positions. Texts without a match cost one search.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def span(hit: Column, end: Column) -> Column:
        return F.struct((end - F.length(hit)).alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("value"))

    def spans(hits: Column) -> Column:
        lengths = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        return F.zip_with(hits, running(lengths, F.lit(0), lambda a, b: a + b), span)

    return F.when(text.rlike(pattern), bound(found, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds in order of start and kind; an ``assign`` span's value is what is assigned."""
    assign = F.transform(matches(text, ASSIGN, "assign", 0), lambda s: s.withField("value", F.regexp_extract(s["value"], ASSIGN, 2)))
    assign = F.filter(assign, lambda s: F.length(s["value"]) >= LEAST_VALUE)
    return F.sort_array(F.concat(assign, matches(text, ACCESS, "access", 1), matches(text, HEX, "hex", 2)))


def opaque_spans(text: Column, base: Column) -> Column:
    """Further candidates that overlap no base span: among all spans by their start, none before reaches one, none after starts in it."""
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
    is_base = lambda s: s["kind_order"] < 3

    def apart(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.lit(0), larger)
        starts = F.transform(F.reverse(spans), lambda s: F.when(is_base(s), s["start"]).otherwise(FAR))
        both = F.arrays_zip(spans.alias("span"), reach.alias("reach"), F.reverse(running(starts, F.lit(FAR), smaller)).alias("next"))
        free = F.filter(both, lambda b: ~is_base(b["span"]) & (b["reach"] <= b["span"]["start"]) & (b["next"] >= b["span"]["end"]))
        return F.transform(free, lambda b: b["span"])

    own = F.filter(matches(text, OPAQUE, "opaque", 3), lambda s: mixed(s["value"]))
    return bound(own, lambda o: F.when(F.size(o) > 0, bound(F.sort_array(F.concat(base, o)), apart)).otherwise(o))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per document with its spans, no texts: doc_id, digest, repository, owner, base, opaque."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.xxhash64(text).alias("digest"), repository.alias("repository"), owner.alias("owner"), text.alias("__text"))
    found = found.withColumn("base", base_spans(F.col("__text")))
    return found.withColumn("opaque", opaque_spans(F.col("__text"), F.col("base"))).drop("__text")


def ownership(found: DataFrame) -> DataFrame:
    """For every candidate value: its hash, documents, distinct repositories and owners.

    Rows are first counted per value, repository and owner (before and after the shuffle), so a value that a third of all
    rows hold reaches the last step as one row for each repository.
    """
    spans = found.select("repository", "owner", F.explode(F.concat("base", "opaque")).alias("s"))
    values = spans.select(F.sha2(F.col("s.value"), 256).alias("value_hash"), "repository", "owner")
    per_repository = values.groupBy("value_hash", "repository", "owner").agg(F.count("*").alias("n"))
    per_owner = per_repository.groupBy("value_hash", "owner").agg(F.count("repository").alias("repositories"), F.sum("n").alias("n"))
    return per_owner.groupBy("value_hash").agg(
        F.sum("n").alias("uses"), F.sum("repositories").alias("repositories"), F.count("owner").alias("owners")
    )


def owner_of(repository: Column) -> Column:
    """The part of a repository's name before the first slash; a name without one is its own owner."""
    return F.substring_index(repository, "/", 1)


def judged(docs: DataFrame, repository: str = "source", owners: int = OWNERS) -> DataFrame:
    """Documents' spans with a verdict on each: doc_id, digest, base, judged (spans with value_hash and live).

    A value is live if at most ``owners`` owners have it and it doesn't look like an example. Null repositories count as no
    owner. Spans are found once and written without texts. Rows that repeat id and text share one row here.
    """
    found = written(candidates(docs, F.col(repository), owner_of(F.col(repository))), "spans")
    known = ownership(found)
    spans = found.select("doc_id", "digest", F.explode(F.concat("base", "opaque")).alias("s")).distinct()
    marked = spans.withColumn("value_hash", F.sha2(F.col("s.value"), 256)).join(known, "value_hash")
    live = (F.col("owners") <= owners) & ~F.col("s.value").rlike(EXAMPLE)
    span = F.struct("s.start", "s.kind_order", "s.end", "s.kind", live.alias("live"))
    per_doc = marked.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(span)).alias("judged"))
    joined = found.select("doc_id", "digest", "base").join(
        per_doc.withColumnsRenamed({"doc_id": "__doc", "digest": "__digest"}), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("digest") == F.col("__digest")), "left"
    )
    return joined.select("doc_id", "digest", "base", F.coalesce("judged", F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string,live:boolean>>")).alias("judged"))


def scan(docs: DataFrame, repository: str = "source", owners: int = OWNERS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    ``spans`` holds all base spans and those opaque ones that few owners have; ``n_live`` and ``n_example`` count the
    spans (opaque included) that are owner-specific and widely copied. Null texts are empty; a text without spans has the digest of nothing and
    empty ``spans``. Repeated rows each get their row.
    """
    rows = judged(docs, repository, owners)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = F.filter("judged", lambda s: (s["kind"] != "opaque") | s["live"])
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(shown).alias("spans"),
        F.size(F.filter("judged", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("judged", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def redacted(docs: DataFrame, repository: str = "source", owners: int = OWNERS) -> DataFrame:
    """``docs`` with the same columns and rows: live spans are replaced by ``[secret]``, other base spans by ``[example]``."""
    rows = judged(docs, repository, owners)
    shown = rows.select(
        F.col("doc_id").alias("__doc"), F.col("digest").alias("__digest"), F.filter("judged", lambda s: (s["kind"] != "opaque") | s["live"]).alias("__spans")
    ).where(F.size("__spans") > 0).dropDuplicates(["__doc", "__digest"])
    text = F.col("text")

    def piece(s, at):  # what is kept before a span, and its mark; spans of two kinds may overlap
        mark = F.when(s["start"] < at, F.lit("")).when(s["live"], F.lit("[secret]")).otherwise(F.lit("[example]"))
        return F.struct(at.alias("at"), F.greatest(s["start"], at).alias("end"), mark.alias("mark"))

    def some(chunk):  # the text of some pieces is cut out of the whole first
        base = chunk[0]["at"]
        own = F.substr(text, base + 1, F.element_at(chunk, -1)["end"] - base)
        return bound(own, lambda t: F.array_join(F.transform(chunk, lambda p: F.concat(F.substr(t, p["at"] - base + 1, p["end"] - p["at"]), p["mark"])), ""))

    def mask(ends):
        before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        parts = F.transform(chunks_of(F.zip_with("__spans", before, piece)), some)
        return F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(ends, -1) + 1))

    masked = bound(running(F.transform("__spans", lambda s: s["end"]), F.lit(0), larger), mask)
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("__digest"))
    joined = docs.join(shown, same, "left")
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked)).select(*docs.columns)
