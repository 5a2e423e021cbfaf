"""Article bodies of raw pages: tags as rows, elements by nesting depth, furniture cut out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements without article text, parts of a class or id that mark page furniture, and where articles stand, best first.
BARE_TAGS = "script style nav header footer aside form button iframe".split()
FURNITURE = "nav|menu|sidebar|footer|header|cookie|newsletter|subscribe|comment|social|share"
PLACES = (("tag", "article"), ("class", "article"), ("class", "content"), ("class", "post"), ("id", "article"), ("id", "content"), ("tag", "main"))
#: Elements that never hold text, and those whose text is not markup.
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
RAW_TAGS = "script style".split()
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: A tag, or the text up to the next one.
TOKEN = r"""</?[a-zA-Z](?:"[^"]*"|'[^']*'|[^'">])*>|[^<]+|<"""


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, in double, single or no quotes; empty where it is absent."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def page_tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(page, key, pos, text, tag, ends, level, other, class, id)``: tags and texts of each row in order.

    ``level`` says how many elements of its name a tag opens within or closes, and ``other`` is the place
    of the tag that closes (or opened) its element. Closing tags without an element have level 0; void
    elements and texts have none.
    """
    plain = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?s)<!--.*?(?:-->|\z)", "")
    for tag in RAW_TAGS:
        plain = F.regexp_replace(plain, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", "")
    rows = pages.select(F.monotonically_increasing_id().alias("page"), F.col(key).alias("key"), plain.alias("html"))
    rows = rows.select("page", "key", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "text"))
    name = F.lower(F.regexp_extract("text", r"^</?([a-zA-Z][^\s/>]*)", 1))
    closed = F.col("text").rlike(r"(?s)^<[a-zA-Z].*/>$") | name.isin(*VOID_TAGS)
    rows = rows.withColumns({"tag": F.when((name != "") & ~closed, name), "ends": F.startswith("text", F.lit("</"))})
    rows = rows.withColumns({c: F.when(F.col("tag").isNotNull() & ~F.col("ends"), _attribute(F.col("text"), c)).otherwise("") for c in ("class", "id")})
    # depth by name; a closing tag with nothing to close leaves it at zero
    own = Window.partitionBy("page", "tag").orderBy("pos")
    step = F.when(F.col("tag").isNull(), 0).when(F.col("ends"), -1).otherwise(1)
    depth = F.sum(step).over(own)
    rows = rows.withColumn("depth", depth)
    rows = rows.withColumn("depth", F.col("depth") - F.least(F.lit(0), F.min("depth").over(own.rowsBetween(Window.unboundedPreceding, 0))))
    stray = F.col("ends") & (F.col("depth") == 0) & (F.coalesce(F.lag("depth").over(own), F.lit(0)) == 0)
    level = F.when(F.col("tag").isNull() | stray, 0).when(F.col("ends"), F.col("depth") + 1).otherwise(F.col("depth"))
    rows = rows.withColumn("level", level)
    pair = Window.partitionBy("page", "tag", "level").orderBy("pos")
    other = F.when(F.col("level") > 0, F.when(F.col("ends"), F.lag("pos").over(pair)).otherwise(F.lead("pos").over(pair)))
    # both tags of an element know its class and id
    shared = {c: F.when(F.col("ends"), F.lag(c).over(pair)).otherwise(F.col(c)) for c in ("class", "id")}
    return rows.withColumns({"other": other, **shared}).drop("depth")


def extract_bodies(pages: DataFrame, key: str = "page_id", html: str = "html", low: int = 300, cut: int = 50_000) -> DataFrame:
    """``(key, body)``: paragraphs of over 40 characters of each page's article, a row for each page with over ``low`` characters.

    Bare elements and those whose class or id names furniture go with all that they hold. The article is the
    first element of the best kind of ``PLACES`` that is left, up to its own closing tag, or else the page.
    A paragraph's texts are trimmed and joined without a separator. An element without a closing tag
    reaches to the end of the page, but a paragraph at most to the next one. Null and empty pages have
    no row; repeated rows and keys are pages of their own.
    """
    rows = page_tokens(pages, key, html)
    whole = Window.partitionBy("page")
    ordered = whole.orderBy("pos")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("level") > 0) & ~F.col("ends")
    chrome = F.col("tag").isin(*BARE_TAGS) | F.col("class").rlike(f"(?i){FURNITURE}") | F.col("id").rlike(f"(?i){FURNITURE}")
    turn = F.when((F.col("level") > 0) & chrome, F.when(F.col("ends"), -1).otherwise(1)).otherwise(0)
    rows = rows.withColumn("turn", turn).withColumn("inside", F.sum("turn").over(so_far))
    rows = rows.where((F.col("inside") == 0) & (F.col("turn") == 0))
    kind = F.lit(None).cast("int")
    for rank in range(len(PLACES) - 1, -1, -1):
        where, word = PLACES[rank]
        hit = F.col("tag") == word if where == "tag" else F.contains(where, F.lit(word))
        kind = F.when(opens & hit, rank).otherwise(kind)
    end = F.coalesce("other", F.lit(2**31 - 1))
    rows = rows.withColumn("place", F.min(F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.col("pos").alias("start"), end.alias("end")))).over(whole))
    rows = rows.where(F.col("place").isNull() | ((F.col("pos") > F.col("place.start")) & (F.col("pos") < F.col("place.end"))))
    # texts belong to the last paragraph opened, if it has not been closed
    mark = F.when(F.col("tag") == "p", F.struct("pos", F.col("ends").alias("over")))
    rows = rows.withColumn("last", F.last(mark, ignorenulls=True).over(so_far))
    texts = rows.where(F.col("tag").isNull() & ~F.startswith("text", F.lit("<")) & F.col("last").isNotNull() & ~F.col("last.over"))
    shown = F.col("text")
    for name, char in ENTITIES:
        shown = F.replace(shown, F.lit(name), F.lit(char))
    texts = texts.select("page", "key", "pos", F.col("last.pos").alias("paragraph"), F.regexp_replace(shown, r"(?U)^\s+|\s+$", "").alias("text"))
    joined = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "text"))), lambda t: t["text"]), "" if name == "pos" else " ")
    parts = texts.groupBy("page", "key", "paragraph").agg(joined("pos").alias("text")).where(F.length("text") > 40)
    bodies = parts.groupBy("page", "key").agg(F.substring(joined("paragraph"), 1, cut).alias("body"))
    return bodies.where(F.length("body") > low).select(F.col("key").alias(key), "body")
