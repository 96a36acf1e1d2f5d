"""Chunk and record builders on cases the tables do not hold."""

from pyspark.sql import functions as F

from loomspark.functions import markup
from loomspark.operators import building as B
from loomspark.plans import registry

PAGES = "id string, overview array<string>, sections array<struct<heading:string,paras:array<string>,lists:array<array<string>>>>, moves array<struct<name:string,text:string,section:string>>, battles array<string>, lore array<string>"


def test_page_chunks(spark):
    long = lambda t: t + " " + "x" * 80
    sections = [("Story", [long("a [12]"), long("a"), "short", long("Its NAMESAKE is b"), None], [[long("Chapter 3: c"), "edit", long("1.2 Chapter 4: no"), long("Wild Chapter 9 : d"), None], None]), ("See also", [long("e")], None), (None, [long("f")], None), ("  ", None, None)]
    rows = [("p2", [long("o"), long("o"), None], sections, [("N", None, None), (" M ", long("m"), "Z"), (None, long("n"), None), (" ", long("n"), None)], [long("Chapter 3: c"), long("b")], [long("Its NAMESAKE is b")]), ("p1", None, None, None, None, None), ("p0", [long("o")], [], [], [], [])]
    got = B.numbered_chunks(B.page_chunks(spark.createDataFrame(rows, PAGES), "id"), "id", 5).orderBy("chunk_id").collect()
    want = [
        ("p0", "ability_overview", long("o"), "(overview)", ""), ("p2", "ability_overview", long("o"), "(overview)", ""), ("p2", "section", long("a"), "Story", ""), ("p2", "lore", long("Its NAMESAKE is b"), "Story", ""),
        ("p2", "battle_record", long("Chapter 3: c"), "Story", ""), ("p2", "battle_record", long("Wild Chapter 9 : d"), "Story", ""), ("p2", "move", long("m"), "Z", "M"), ("p2", "battle_record", long("b"), "CHAPTERS", ""),
    ]
    assert [(r.id, r.chunk_type, r.content, r.section, r.entity) for r in got] == want and [r.chunk_id for r in got] == list(range(5, 13))
    none = spark.createDataFrame([], PAGES)
    assert B.numbered_chunks(B.page_chunks(none, "id"), "id").count() == 0


def test_article_chunks(spark):
    text = "w " * 50
    rows = [(1, "stand", None, f"{text}\n== H ==\n{text}"), (2, "location", True, text), (3, "location", False, text), (4, "location", None, text), (5, "arc", None, "short"), (6, "character", None, None), (7, None, None, text), (8, "arc", None, "{{lang|" + text)]
    base = spark.createDataFrame([(41,), (7,)], "chunk_id long")
    got = B.article_chunks(spark.createDataFrame(rows, "eid long, kind string, included boolean, wikitext string"), "eid", "kind", base).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.stand_id, r.location_id, r.section, r.content_len) for r in got] == [(42, None, 2, "(lead)", 99), (43, 1, None, "(lead)", 200)]
    assert B.article_chunks(spark.createDataFrame([], "eid long, kind string, included boolean, wikitext string"), "eid", "kind", base.where("false")).count() == 0


def test_built_records(spark):
    rows = [(1, "a", 3), (2, "a", 1), (3, "a", 9), (4, None, 1), (5, "b", None), (6, "b", 1), (7, None, 9)]
    pages = spark.createDataFrame(rows, "k long, name string, n long")
    kept, out = B.built_records(pages, "k", [("nine", F.col("n") == 9), ("nameless", F.col("name").isNull())], {"id": F.upper("name")}, "id")
    assert sorted(map(tuple, kept.collect())) == [(1, "A"), (5, "B")]
    assert sorted(map(tuple, out.collect())) == [(2, "duplicate"), (3, "nine"), (4, "nameless"), (6, "duplicate"), (7, "nine")]


def test_rendered_chunks(spark, tmp_path):
    page = "<nav><p>{0}</nav><h1>t</h1><p>{0}a<p>{0}b<h2>Gallery</h2><p>{0}c<h2>Life</h2><div><p>{0}d [3]</div><ul><li>Chapter 2: {0}<li>Jump to {0}</ul><footer><p>{0}</footer>"
    html = [page.format("y" * 90), None, "<p>short", page.format("z" * 81)]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.queries()["rendered_chunks"](spark, str(tmp_path)).orderBy("chunk_id").collect()
    want, n = [], 0
    for i, h in enumerate(html):
        p = markup.rendered(h)
        mine = [("ability_overview", t, "(overview)") for t in p["overview"]]
        for s in p["sections"]:
            if s["heading"] != "Gallery":
                mine += [("section", t, s["heading"]) for t in s["paras"]] + [("battle_record", t, s["heading"]) for x in s["lists"] for t in x if t.startswith("Chapter")]
        for kind, text, section in mine:
            if len(text) >= 80:
                n += 1
                want.append((n, i, kind, text, section, ""))
    assert [tuple(r) for r in got] == want and len(want) == 8


def test_infobox_pages_reads_references_as_its_sql(spark, tmp_path):
    import duckdb

    titles = ["a &amp;&amp;&amp", "token = &quot;x&quot;", "&lt;b&gt; &copy; [1] c", "&amp;lt; & d", "&ampe; &lt"]
    spark.createDataFrame([(i, f"<nav>&amp</nav><h1>{t}</h1><p>x") for i, t in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(registry.oracle_sql()["infobox_pages"]).fetchall()
    assert sorted(tuple(r) for r in registry.queries()["infobox_pages"](spark, str(tmp_path)).collect()) == sorted(want)
