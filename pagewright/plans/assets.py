"""Plans over image links and the files behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assets as A
from .registry import query, table

_LINKS = (
    "![ A ](pic.png)", "![](<sub dir/x y.jpg> \"title\")", "![r](https://h/x.png)", "![abs](/abs/z.gif)", "![out](assets/o.png)", "![no](missing.png)", "![s](_assets/s.png)", "![D](DATA:image/png;base64,AA)", "![]( )",
)
_FILES = ("/w/img/{}/pic.png", "/src/sub dir/x y.jpg", "/abs/z.gif", "/w/out/assets/o.png")


def _docs(spark, d):
    """Every text with nine links, as Markdown of a document in folders of its own; images for two of three pic.png."""
    docs = table(spark, d, "documents").where("text is not null")
    ident = F.col("doc_id").cast("string")
    md = F.concat_ws("\n", *[F.lit(x) for x in _LINKS[:5]], F.col("text"), *[F.lit(x) for x in _LINKS[5:]])
    return docs.select("doc_id", md.alias("md"), F.concat(F.lit("Doc "), ident).alias("stem"), F.concat(F.lit("/w/img/"), ident).alias("image_dir"), F.lit("/src").alias("source_dir"), F.lit("/w/out").alias("out_dir"))


def _files(spark, d):
    own = table(spark, d, "documents").where("text is not null and doc_id % 3 <> 0").select(F.format_string("/w/img/%d/pic.png", "doc_id").alias("path"), F.col("text").cast("binary").alias("data"))
    shared = spark.createDataFrame([(p, p.encode()) for p in _FILES[1:]], "path string, data binary")
    return own.unionByName(shared)


def _id_sql(occurrence: str, data: str) -> str:
    return f"'img_' || substring(sha256('Doc ' || doc_id || '|' || ({occurrence}) || '|' || {data}), 1, 16)"


_STAGED_SQL = f"""o AS (SELECT doc_id, text, (doc_id % 3 <> 0)::INT AS own FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, text, 3 + own AS n_changed, CASE WHEN own = 1 THEN '![A](okf-asset://' || {_id_sql('1', 'text')} || ')' ELSE '![ A ](pic.png)' END AS l0, '![](okf-asset://' || {_id_sql('1 + own', "'/src/sub dir/x y.jpg'")} || ')' AS l1,
  '![abs](okf-asset://' || {_id_sql('2 + own', "'/abs/z.gif'")} || ')' AS l3, '![out](okf-asset://' || {_id_sql('3 + own', "'/w/out/assets/o.png'")} || ')' AS l4 FROM o)"""


@query(f"""WITH {_STAGED_SQL} SELECT doc_id, n_changed::INT AS n_changed, sha256(concat_ws(chr(10), l0, l1, '{_LINKS[2]}', l3, l4, text, '{"','".join(_LINKS[5:])}')) AS md_sha256 FROM s""")
def link_rewrite(spark, d):
    """Links to known files rewritten to ids of the asset store; all others stay."""
    docs, _ = A.stage_images(_docs(spark, d), _files(spark, d))
    return docs.select("doc_id", "n_changed", F.sha2("md", 256).alias("md_sha256"))


@query(f"""WITH {_STAGED_SQL}, ids AS (SELECT doc_id, text, unnest([l0, l1, l3, l4]) AS l, unnest(['png', 'jpg', 'gif', 'png']) AS ext, unnest([strlen(text), 20, 10, 19])::INT AS n FROM s)
SELECT DISTINCT regexp_extract(l, 'okf-asset://([^)]*)', 1) AS asset_id, ext, n AS n_bytes FROM ids WHERE contains(l, 'okf-asset')""")
def asset_store(spark, d):
    """The store behind those ids, each once."""
    _, store = A.stage_images(_docs(spark, d), _files(spark, d))
    return store.select("asset_id", "ext", F.octet_length("data").alias("n_bytes"))


@query("""WITH a AS (SELECT doc_id, k AS img_no, CASE WHEN k % 3 = 0 AND text IS NOT NULL THEN 'used' ELSE 'a/p' || k || '.png' END AS src, CASE WHEN k = 4 THEN NULL ELSE k * 6.0 END AS w, 9.0 AS h, text FROM documents, range(1, 7) AS t(k) WHERE text IS NOT NULL),
l AS (SELECT doc_id, string_agg('![](' || src || ')' || chr(10), '' ORDER BY img_no) AS g, count(*) AS n FROM a WHERE src <> 'used' AND (w IS NULL OR w * h >= 100) GROUP BY doc_id)
SELECT doc_id, n::INT AS n_gallery, sha256(text || ' ![](a/p3.png) ![x](a/p6.png)' || chr(10) || chr(10) || g) AS md_sha256 FROM l JOIN documents USING (doc_id)""")
def gallery_unreferenced(spark, d):
    """Images that no text references, large enough or of unknown size, as a gallery."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat("text", F.lit(" ![](a/p3.png) ![x](a/p6.png)")).alias("md"))
    k = F.col("img_no")
    assets = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("img_no")).select("doc_id", "img_no", F.format_string("a/p%d.png", k).alias("src"), F.when(k != 4, k * 6.0).alias("width"), F.lit(9.0).alias("height"))
    return A.with_gallery(docs, assets).select("doc_id", "n_gallery", F.sha2("md", 256).alias("md_sha256"))


def _picture_sql(k: int) -> str:
    return f"'assets/office/' || {_id_sql(str(k), chr(39) + 'data' + chr(39) + f' || {k}')} || '.png'"


@query(f"""SELECT doc_id, sha256('![own](' || {_picture_sql(1)} || ') ![](http://u/x) ' || text || ' ![alt2](' || {_picture_sql(2)} || ')' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '![alt3](' || {_picture_sql(3)} || ')' || chr(10) ELSE '' END) AS md_sha256 FROM documents WHERE text IS NOT NULL""")
def office_pictures(spark, d):
    """Pictures paired with local links by their places; what is left becomes a gallery."""
    docs = table(spark, d, "documents").where("text is not null")
    ident = F.col("doc_id").cast("string")
    rows = docs.select("doc_id", F.concat(F.lit("![own](media/1.png) ![](http://u/x) "), F.col("text"), F.lit(" ![](m2)")).alias("md"), F.concat(F.lit("Doc "), ident).alias("stem"))
    k = F.col("img_no")
    pictures = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 2 == 0, 3).otherwise(2))).alias("img_no")).select("doc_id", "img_no", F.format_string("alt%d", k).alias("alt"), F.lit("png").alias("ext"), F.format_string("data%d", k).cast("binary").alias("data"))
    return A.pair_pictures(rows, pictures).select("doc_id", F.sha2("md", 256).alias("md_sha256"))


@query("""SELECT doc_id, sha256(CASE WHEN strlen(text) BETWEEN 1 AND 2000 THEN 'data:' || CASE doc_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/svg+xml' WHEN 2 THEN 'image/webp' ELSE 'image/png' END || ';base64,' || base64(text::BLOB)
  ELSE 'a.' || (['JPG', 'svg', 'webp', 'tif'])[(doc_id % 4 + 1)::INT] END) AS src_sha256 FROM documents WHERE text IS NOT NULL""".replace("text::BLOB", "encode(text)"))
def figure_source(spark, d):
    """Figures as data URIs where they are small enough."""
    path = F.concat(F.lit("a."), F.get(F.array(*map(F.lit, ("JPG", "svg", "webp", "tif"))), (F.col("doc_id") % 4).cast("int")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(A.embedded_source(path, F.col("text").cast("binary"), True, 2000), 256).alias("src_sha256"))
