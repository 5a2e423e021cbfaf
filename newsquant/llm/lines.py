"""Operator 6: fuzzy line dedup by MinHash, DataFrame functions only.

A line's shingles are its runs of ``chars`` characters, one from every position (a shorter line is
one shingle). Equal lines collapse by hash before anything else. The signature is a
one-permutation MinHash: the hash range is cut into ``n_bands * rows`` bins and a line keeps its
smallest shingle hash in each. As only minima count, hashes that can hardly be one are left out
before the grouping: ``deep`` hashes per bin stay on average. A band is ``rows`` bins, and lines
that share a band meet in a bucket.

(1) In each bucket every line is verified against the bucket's most frequent line by exact Jaccard
similarity of the shingle sets, so a large group of copies takes as many comparisons as it has
lines; union-find joins what links. (2) Lines of a bucket that are then still in different
components are compared with each other, linked ones included. Each is held as what it lacks of
the head's shingles and what it has beyond them, short lists for which bit masks bound the
similarity from above; pairs that the bound leaves are tested exactly. Both tests are part of the
join's condition, so only links leave the join. Each pair that shares a band is thus linked, or in
one component already, or verified not to link.
Of a component only the line with the smallest (document, position) stays.

What can be missed is a pair that shares no band: 1.5 % of pairs at similarity 0.8 exactly,
0.03 % at 0.9.

Null and empty texts have no lines; lines of white space alone always stay. A line that occurs
twice in one document stays once. Repeated rows of one id are one document: each loses the same
positions. Rows with a null id take no part and keep all. Ties of similarity at the threshold
link. A very long line costs time in proportion to its length. Two different lines with equal
64-bit hashes would count as equal. An empty table gives an empty result. Columns named like
inner ones (``_doc``, ``_removed``) are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components

#: Half of the hash range, as hashes are cut to 31 bits.
_RANGE = 1 << 31
#: Words of 64 bits in a mask of a list of shingles.
_WORDS = 4


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(line: Column, chars: int) -> Column:
    """Hashes of all runs of ``chars`` characters, repeats included."""
    last = lambda raw: F.greatest(F.octet_length(raw) - (2 * chars - 1), F.lit(1))
    cut = lambda raw: F.transform(F.sequence(F.lit(1), last(raw), F.lit(2)), lambda at: F.xxhash64(F.substring(raw, at, F.lit(2 * chars))))
    return _let(F.encode(line, "UTF-16BE"), cut)


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def signatures(lines: DataFrame, chars: int, n_bands: int, rows: int, deep: int) -> DataFrame:
    """``(id, n, keys)`` of ``lines(id, n, line)``: a bucket key for each band that is not empty.

    ``lines`` should be dealt by ``id``, so that nothing shuffles.
    """
    bins = n_bands * rows
    places = F.greatest(F.length("line") - (chars - 1), F.lit(1))
    raw = lines.select("id", "n", F.encode("line", "UTF-16BE").alias("raw"), places.alias("places"))
    limit = (F.least(F.lit(1.0), F.lit(float(deep * bins)) / F.col("places")) * float(_RANGE)).cast("long")
    raw = raw.select("id", "n", "raw", limit.alias("limit"), "places")
    at = raw.select("id", "n", "raw", "limit", F.explode(F.sequence(F.lit(1), F.col("places") * 2 - 1, F.lit(2))).alias("at"))
    h = at.select("id", "n", "limit", F.xxhash64(F.substring("raw", F.col("at"), F.lit(2 * chars))).alias("h"))
    h = h.where(F.col("h").bitwiseAND(F.lit(_RANGE - 1)) < F.col("limit"))
    place = (F.shiftrightunsigned("h", 32) * bins / float(2**32)).cast("int")
    h = h.select("id", "n", place.alias("bin"), F.col("h").bitwiseAND(F.lit(_RANGE - 1)).cast("int").alias("v"))
    h = h.select("id", "n", F.floor(F.col("bin") / rows).cast("int").alias("band"), (F.col("bin") % rows).alias("row"), "v")
    mins = h.groupBy("id", "n", "band").agg(*[F.min(F.when(F.col("row") == r, F.col("v")).otherwise(_RANGE - 1)).alias(f"m{r}") for r in range(rows)])
    keyed = mins.select("id", "n", "band", F.xxhash64("band", *[f"m{r}" for r in range(rows)]).alias("key"))
    out = keyed.groupBy("id", "n").agg(*[F.max(F.when(F.col("band") == b, F.col("key"))).alias(f"k{b}") for b in range(n_bands)])
    return out.select("id", "n", F.array_compact(F.array(*[f"k{b}" for b in range(n_bands)])).alias("keys"))


def bucket_members(marked: DataFrame) -> DataFrame:
    """``(bucket, id, n, most)`` of the buckets of ``marked(id, n, keys)`` with two lines or more; ``most`` is a bucket's largest ``n``."""
    # dealt once, for the count and for the join; few buckets are shared, so they are looked up instead of sorting all
    dealt = marked.select(F.explode("keys").alias("bucket"), "id", "n").repartition("bucket")
    shared = dealt.groupBy("bucket").agg(F.count("id").alias("many"), F.max("n").alias("most")).where("many > 1").select("bucket", "most")
    return dealt.join(shared.hint("shuffle_hash"), "bucket").select("bucket", "id", "n", "most")


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` of ``rows(head, id)``, spread over all tasks: few bytes, but much work each."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(F.col("head").alias("a"), F.col("id").alias("b")).repartition(parts, "a", "b").distinct()


def compared(pairs: DataFrame, texts: DataFrame, chars: int) -> DataFrame:
    """``(a, b, whole, less, more)`` of ``pairs(a, b)`` among ``texts(id, line)``: how many shingles ``a`` has, which of them ``b`` lacks and which ``b`` has beyond them."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("a_line")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("line").alias("b_line")), "b")
    sets = F.struct(shingles(F.col("a_line"), chars).alias("x"), shingles(F.col("b_line"), chars).alias("y"))
    body = lambda s: F.struct(F.size(F.array_distinct(s["x"])).alias("whole"), F.array_except(s["x"], s["y"]).alias("less"), F.array_except(s["y"], s["x"]).alias("more"))
    # a generator of one row, which the optimizer neither merges nor repeats
    return both.select("a", "b", F.inline(F.array(_let(sets, body))))


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of the :func:`compared` pairs whose shingle sets have at least ``threshold`` Jaccard similarity."""
    common = F.col("whole") - F.size("less")
    return pairs.where(_links(common, F.col("whole") + common + F.size("more"), threshold)).select("a", "b")


def _links(common: Column, sizes: Column, threshold: float) -> Column:
    """``common / (sizes - common) >= threshold`` without a division."""
    return common * (1 + threshold) >= sizes * threshold - 1e-9


def _masks(values: str, name: str) -> list[Column]:
    """``_WORDS`` longs with a bit set for each of ``values``."""
    word = lambda w: F.filter(values, lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(_WORDS - 1)) == w)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return [F.aggregate(word(w), F.lit(0).cast("long"), lambda m, h: m.bitwiseOR(bit(h))).alias(f"{name}{w}") for w in range(_WORDS)]


def _only(a: str, b: str) -> Column:
    """How many bits of the masks ``a`` those of ``b`` lack."""
    bits = [F.bit_count(F.col(f"{a}{w}").bitwiseAND(F.bitwise_not(f"{b}{w}"))) for w in range(_WORDS)]
    return sum(bits[1:], bits[0])


def rest_links(members: DataFrame, heads: DataFrame, known: DataFrame, apart: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """Components ``(a, b)`` of linked lines of one bucket that are neither its head nor in one component yet; ``apart`` are its :func:`compared` pairs."""
    rows = members.join(heads, "bucket").where("id <> head")
    rows = rows.join(known, "id", "left").select("bucket", "head", "id", F.coalesce("component", "id").alias("own"))
    mixed = rows.groupBy("bucket").agg(F.min("own").alias("first"), F.max("own").alias("last")).where("first < last").select("bucket")
    rows = scratch.save(rows.join(mixed, "bucket", "left_semi"))
    pairs = rows.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    apart = apart.join(pairs, ["a", "b"], "left_semi")
    apart = scratch.save(apart.select(F.col("a").alias("head"), F.col("b").alias("id"), "whole", "less", "more", *_masks("less", "l"), *_masks("more", "m")))
    rows = rows.join(apart, ["head", "id"]).drop("head")
    left, right = (rows.select("bucket", *[F.col(c).alias(f"{x}_{c}") for c in rows.columns if c != "bucket"]) for x in "ab")
    n = {x: [F.size(f"{x}_less"), F.size(f"{x}_more")] for x in "ab"}
    sizes = F.col("a_whole") * 2 - n["a"][0] - n["b"][0] + n["a"][1] + n["b"][1]
    most = F.col("a_whole") - n["a"][0] - _only("b_l", "a_l") + n["a"][1] - _only("a_m", "b_m")
    exact = F.col("a_whole") - F.size(F.array_union("a_less", "b_less")) + _common(F.col("a_more"), F.col("b_more"))
    on = (left["bucket"] == right["bucket"]) & (F.col("a_id") < F.col("b_id")) & (F.col("a_own") != F.col("b_own")) & _links(most, sizes, threshold) & _links(exact, sizes, threshold)
    return left.join(right, on).select(F.col("a_own").alias("a"), F.col("b_own").alias("b")).distinct()


def line_components(lines: DataFrame, scratch: Scratch, threshold: float = 0.8, chars: int = 9, n_bands: int = 8, rows: int = 4, deep: int = 3) -> DataFrame:
    """``(id, component)`` of the distinct ``lines(id, n, line)`` that link; ``n`` says how often a line occurs."""
    marked = scratch.save(signatures(lines, chars, n_bands, rows, deep))
    members = scratch.save(bucket_members(marked))
    scratch.free(marked)
    texts = scratch.save(lines.select("id", "line").join(members.select("id").distinct(), "id", "left_semi"))
    heads = scratch.save(members.where("n = most").groupBy("bucket").agg(F.max("id").alias("head")))
    # the sets of a pair are made once, for both steps
    apart = scratch.save(compared(_pairs(members.join(heads, "bucket").where("id <> head")), texts, chars))
    scratch.free(texts)
    known = components(verified(apart, threshold), scratch)
    more = scratch.save(rest_links(members, heads, known, apart, scratch, threshold))
    scratch.free(members, heads, apart)
    # only components that link are labelled anew: all that more names and known lacks are lines of their own
    merged = components(more, scratch)
    low = merged.select(F.col("id").alias("component"), F.col("component").alias("low"))
    found = known.join(low, "component", "left").select("id", F.coalesce("low", "component").alias("component"))
    found = scratch.save(found.unionByName(merged.join(known, "id", "left_anti")))
    scratch.free(more)
    scratch.release()
    return found


def _line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("no", "line"))
    return own.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("id", F.xxhash64("line"))


def _gone_lines(docs: DataFrame, key: str, text: str, threshold: float, **how) -> DataFrame:
    """``(doc, no, id)`` of every line that an earlier line of its component stands for."""
    scratch = Scratch(docs.sparkSession, "lines")
    occurrences = _line_rows(docs, key, text)
    distinct = occurrences.groupBy("id").agg(F.min(F.struct("doc", "no")).alias("first"), F.count("*").alias("n"), F.first("line").alias("line"))
    distinct = scratch.save_bucketed(distinct, "id")
    found = line_components(distinct.select("id", "n", "line"), scratch, threshold, **how)
    heads = distinct.select("id", "first", "n").join(found, "id", "left")
    alone = heads.where("component is null and n > 1").select("id", F.col("first").alias("keep"))
    grouped = heads.where("component is not null")
    keep = grouped.groupBy("component").agg(F.min("first").alias("keep"))
    keep = scratch.save(alone.unionByName(grouped.join(keep, "component").select("id", "keep")))
    scratch.free(distinct)
    return occurrences.select("doc", "no", "id").join(keep, "id").where(F.struct("doc", "no") != F.col("keep")).select("doc", "no", "id")


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, **how) -> DataFrame:
    """``(doc, removed)``: sorted positions (from 0) of the lines to drop, for documents that lose any.

    ``how`` goes to :func:`line_components`: ``chars``, ``n_bands``, ``rows`` and ``deep``.
    """
    return _gone_lines(docs, key, text, threshold, **how).groupBy("doc").agg(F.sort_array(F.collect_set("no")).alias("removed"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, **how) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay; all columns and rows are kept."""
    gone = _gone_lines(docs.select(key, text), key, text, threshold, **how)
    gone = gone.groupBy("doc").agg(F.collect_set(F.struct("no", "id")).alias("removed"))
    rows = docs.select(F.col(key).alias("doc"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(gone, "doc", "left")
    own = F.col("row")[text]

    def reduced(lines: Column) -> Column:
        # a row with a repeated id loses a line only where it holds that very line
        held = F.filter("removed", lambda r: F.xxhash64(F.get(lines, r["no"])) == r["id"])
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(held, lambda r: r["no"]))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    own = F.when(F.col("removed").isNull(), own).otherwise(_let(F.split(own, "\n"), reduced))
    return out.select(*[own.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = removed_lines(docs)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    sizes = docs.select("doc_id", F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"))
    out = sizes.join(gone, sizes["doc_id"] == gone["doc"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))
