"""Image links of Markdown and the files behind them: content-addressed ids, rewriting, galleries.

Links are exploded with their places, resolved by equi-joins on file paths, numbered, and put back in order. Texts
without a link never leave their row. A ``docs`` frame has ``doc_id`` (unique) and ``md``.

Nulls: a null md stays null. A link whose file is unknown stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import best_of

STORE = "_assets"
SCHEME = "okf-asset://"
LINK = r"(?d)!\[(.*?)\]\((.*?)\)"
MIN_GALLERY_AREA, MAX_EMBED_BYTES = 100.0, 262_144


def asset_id(stem, occurrence, data) -> Column:
    """``img_`` and 16 hex digits of the hash of owner, occurrence and bytes: the same on every run."""
    head = F.concat(stem, F.lit("|"), occurrence.cast("string"), F.lit("|")).cast("binary")
    return F.concat(F.lit("img_"), F.substring(F.sha2(F.concat(head, data), 256), 1, 16))


def target(raw) -> Column:
    """The path of a link target: what is in angle brackets, else the first word."""
    t = T.trim(raw)
    return F.when(F.rlike(t, F.lit("^<[^>]*>")), F.regexp_extract(t, "^<([^>]*)>", 1)).otherwise(F.regexp_extract(t, r"(?U)^(\S*)", 1))


def is_external(src) -> Column:
    return F.rlike(F.lower(src), F.lit(r"^(?:https?://|okf-asset://|data:)"))


def links(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, place (from 0), alt, src, link of every image link."""
    rows = docs.where(F.contains("md", F.lit("![")))
    found = rows.select("doc_id", *keep, F.posexplode(F.regexp_extract_all("md", F.lit(LINK), F.lit(0))).alias("place", "link"))
    return found.select("doc_id", *keep, "place", "link", T.trim(F.regexp_extract("link", LINK, 1)).alias("alt"), F.regexp_extract("link", LINK, 2).alias("raw")).withColumn("src", target(F.col("raw"))).drop("raw")


def relink(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``docs`` with the links at ``changed`` (doc_id, place, new) exchanged, and ``n_changed``."""
    by_doc = changed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "new"))).alias("__new"), F.count(F.lit(1)).cast("int").alias("n_changed"))
    rows = docs.join(by_doc, "doc_id", "left")

    def pieces(old):
        return F.transform(F.split("md", LINK, -1), lambda p, i: F.concat(p, F.coalesce(F.element_at("__new", i), F.get(old, i), F.lit(""))))

    joined = F.array_join(T.let(F.regexp_extract_all("md", F.lit(LINK), F.lit(0)), pieces), "")
    md = F.when(F.col("__new").isNull(), F.col("md")).otherwise(joined)
    return rows.withColumn("md", md).withColumn("n_changed", F.coalesce("n_changed", F.lit(0))).drop("__new")


def stage_images(docs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links to known files become links to the asset store.

    ``docs``: doc_id, md, stem, image_dir, source_dir, out_dir; ``files``: path, data. A link is looked for by its base
    name in image_dir, then by its path from source_dir, then as an absolute path, then from out_dir. Returns docs with
    ``n_changed``, and the store: asset_id, ext, data, once each.
    """
    found = links(docs, "stem", "image_dir", "source_dir", "out_dir")
    found = found.where((F.col("src") != "") & ~is_external(F.col("src")) & ~F.startswith("src", F.lit(f"{STORE}/")))
    join = lambda folder, name: F.concat(F.col(folder), F.lit("/"), name)
    absolute = F.startswith("src", F.lit("/"))
    # joining a folder with an absolute path gives that path
    places = F.array(
        join("image_dir", F.regexp_extract("src", "([^/]*)/*$", 1)),
        F.when(absolute, F.col("src")).otherwise(join("source_dir", F.col("src"))),
        F.when(absolute, F.col("src")).otherwise(join("out_dir", F.col("src"))),
    )
    tries = found.select("doc_id", "stem", "place", "alt", F.posexplode(places).alias("step", "path"))
    hits = best_of(tries.join(files.select("path"), "path"), ["doc_id", "place"], [F.col("step"), F.col("path")])
    numbered = hits.withColumn("occurrence", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")))
    # links are settled by paths alone; the bytes come last and once
    named = numbered.join(files.select("path", "data"), "path").withColumn("asset_id", asset_id(F.col("stem"), F.col("occurrence"), F.col("data")))
    ext = T.extension(F.col("path"))
    store = named.select("asset_id", F.when(ext == "", "bin").otherwise(ext).alias("ext"), "data").dropDuplicates(["asset_id", "ext"])
    new = F.concat(F.lit("!["), F.col("alt"), F.lit(f"]({SCHEME}"), F.col("asset_id"), F.lit(")"))
    return relink(docs, named.select("doc_id", "place", new.alias("new"))), store


def embedded_source(path, data, embed: bool = False, max_bytes: int = MAX_EMBED_BYTES) -> Column:
    """A figure's link target: its path, or a data URI if that is asked for and the file is neither empty nor too large."""
    if not embed:
        return path
    ext = T.extension(path)
    mime = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("gif", "webp"), F.concat(F.lit("image/"), ext)).when(ext == "svg", "image/svg+xml").otherwise("image/png")
    uri = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\s", ""))
    return F.when(F.octet_length(data).between(1, max_bytes), uri).otherwise(path)


def with_gallery(docs: DataFrame, assets: DataFrame, min_area: float = MIN_GALLERY_AREA) -> DataFrame:
    """Images that a document's text never references, appended in order of img_no; decoration is left out.

    ``assets``: doc_id, img_no, src, width, height (null where the place is unknown: such images stay candidates).
    """
    shown = F.coalesce(F.col("width") * F.col("height") >= min_area, F.lit(True))
    gathered = assets.where(shown).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("img_no", "src"))).alias("__g"))

    def inline(g):
        return F.when(F.startswith(g["src"], F.lit("data:")), F.contains("md", g["src"])).otherwise(F.contains("md", F.concat(F.lit("("), g["src"], F.lit(")"))))

    # a text meets its images inside its row
    left = F.filter("__g", lambda g: ~F.coalesce(inline(g), F.lit(False)))
    out = docs.join(gathered, "doc_id", "left").withColumn("__g", left)
    gallery = F.array_join(F.transform("__g", lambda g: F.concat(F.lit("![]("), g["src"], F.lit(")\n"))), "")
    n = F.coalesce(F.size("__g"), F.lit(0))
    return out.withColumn("md", F.when(n > 0, F.concat("md", F.lit("\n\n"), gallery)).otherwise(F.col("md"))).withColumn("n_gallery", n).drop("__g")


def pair_pictures(docs: DataFrame, pictures: DataFrame, folder: str = "assets/office") -> DataFrame:
    """The n-th local link takes the n-th picture of its document; pictures beyond the links follow as a gallery.

    ``docs`` has ``stem``; ``pictures``: doc_id, img_no (from 1, in order), alt, ext, data.
    """
    return paired_pictures(docs, pictures, folder)[0]


def paired_pictures(docs: DataFrame, pictures: DataFrame, folder: str = "assets/office") -> tuple[DataFrame, DataFrame]:
    """``pair_pictures``, and the files that its links name: path, data."""
    named = pictures.join(docs.select("doc_id", "stem"), "doc_id").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("img_no")))
    named = named.withColumn("path", F.concat(F.lit(f"{folder}/"), asset_id(F.col("stem"), F.col("n"), F.col("data")), F.lit("."), F.col("ext")))
    staged = named.select("doc_id", "n", F.coalesce("alt", F.lit("")).alias("own_alt"), "path")
    local = links(docs).where((F.col("src") != "") & ~is_external(F.col("src")) & ~F.startswith(F.lower("src"), F.lit(f"{STORE}/")))
    local = local.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")))
    pairs = local.join(staged, ["doc_id", "n"])
    alt = F.when(F.col("alt") == "", F.col("own_alt")).otherwise(F.col("alt"))
    done = relink(docs, pairs.select("doc_id", "place", F.concat(F.lit("!["), alt, F.lit("]("), F.col("path"), F.lit(")")).alias("new")))
    rest = staged.join(pairs.select("doc_id", "n"), ["doc_id", "n"], "left_anti").join(done.select("doc_id", "md"), "doc_id")
    rest = rest.where(~F.contains("md", F.concat(F.lit("("), F.col("path"), F.lit(")"))))
    line = F.concat(F.lit("!["), F.col("own_alt"), F.lit("]("), F.col("path"), F.lit(")\n"))
    gallery = rest.withColumn("line", line).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda g: g["line"]), "").alias("__g"))
    out = done.join(gallery, "doc_id", "left")
    return out.withColumn("md", F.concat("md", F.coalesce(F.concat(F.lit("\n\n"), F.col("__g")), F.lit("")))).drop("__g"), named.select("path", "data").dropDuplicates(["path"])
