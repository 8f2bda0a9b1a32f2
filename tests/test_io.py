import pytest
from pyspark.sql import functions as F, types as T

from quern.operators import cluster, graph
from quern.sources import readers, writers
from quern.streaming import ingest


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\nline', 0.5), (2, "N/A", None)], "i long, s string, d double")
    writers.csv(df, str(tmp_path / "c"))
    back = readers.csv(spark, str(tmp_path / "c"), T.StructType.fromDDL("i long, s string, d double")).orderBy("i").collect()
    assert [tuple(r) for r in back] == [(1, 'a "quoted"\nline', 0.5), (2, None, None)]


def test_articles(spark, tmp_path):
    (tmp_path / "a.md").write_text("title: T one\nlink: https://x.y\npath: p.pdf\n---\nBody\n---\nmore")
    (tmp_path / "b.pdf").write_bytes(b"%PDF good")
    (tmp_path / "c.pdf").write_bytes(b" ")
    (tmp_path / "d.PDF").write_bytes(b"no")
    r = readers.markdown_files(spark, str(tmp_path)).collect()
    assert [(x.title, x.link, x.path, x.body) for x in r] == [("T one", "https://x.y", "p.pdf", "Body\n---\nmore")]
    parsed = readers.parse_pdfs(readers.pdf_files(spark, str(tmp_path)), lambda: lambda b: b.decode().strip().replace("%PDF ", "# ")).collect()
    assert sorted((x.path[-5:], x.markdown, x.error) for x in parsed) == [("b.pdf", "# good", None), ("c.pdf", None, "empty")]


def test_bibtex_and_filter(spark, tmp_path):
    (tmp_path / "x.bib").write_text("@inproceedings{k1,\n title = {Open Source work},\n abstract = {About it.},\n}\n@article{k2, title={no}}\n@inproceedings{k3, title = {Else}, abstract = {Nothing},}")
    b = readers.bibtex(spark, str(tmp_path / "x.bib"))
    assert sorted((r.title, r.abstract) for r in b.collect()) == [("Else", "Nothing"), ("Open Source work", "About it.")]
    assert readers.about(b, ["OPEN source"], ["title", "abstract"]).count() == 1


def test_benchmark_fallback(spark, tmp_path):
    pairs = readers.benchmark_pairs(spark, str(tmp_path / "none.parquet"), 1, 5, [("a", "b", 4.0)])
    assert pairs.collect()[0].score == 4.0 and not list(tmp_path.iterdir())
    spark.createDataFrame([("a", "b", 3.0)], "sentence1 string, sentence2 string, score double").write.parquet(str(tmp_path / "p.parquet"))
    assert readers.benchmark_pairs(spark, str(tmp_path / "p.parquet"), 1, 5, []).collect()[0].score == 2.5
    # paths of any store, and a cache that outlives its source
    path, cache = f"file://{tmp_path}/p.parquet", str(tmp_path / "cache")
    assert readers.benchmark_pairs(spark, path, 1, 5, [], cache).collect()[0].score == 2.5
    assert readers.benchmark_pairs(spark, f"file://{tmp_path}/none.csv", 1, 5, [("x", "y", 1.0)], cache).collect()[0].score == 2.5
    writers.csv(spark.createDataFrame([("a", "b", 5.0)], "sentence1 string, sentence2 string, score double"), str(tmp_path / "c.csv"))
    assert readers.benchmark_pairs(spark, str(tmp_path / "c.csv"), 1, 5, []).collect()[0].score == 5.0


def test_pages_and_json(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.pdf").write_bytes(b" ")

    def tool():
        def read(content):
            if not content.strip():
                raise ValueError("empty")
            return content.decode(), "Author: x\nTitle:  The work \n"

        return read

    got = sorted((r.path[-5:], r.page, r.document_title, r.error) for r in readers.pdf_pages(readers.pdf_files(spark, str(tmp_path)), tool).collect())
    assert got == [("a.pdf", "one", "The work", None), ("b.pdf", "", "", "ValueError: empty")]
    (tmp_path / "d.json").write_text('{"a": 1,\n "b": [{"c": "x"}]}')
    assert readers.json_documents(spark, str(tmp_path / "d.json"), T.StructType.fromDDL("a long, b array<struct<c: string>>")).collect()[0].b[0].c == "x"
    (tmp_path / "plain.csv").write_text("s,n\nN/A,\nx,2\n")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "plain.csv"), T.StructType.fromDDL("s string, n string"), null_words=False).collect()] == [("N/A", ""), ("x", "2")]


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    df = spark.createDataFrame([("H1", " YES & no "), ("H2", None), ("", "x")], "item_id string, answer string")
    writers.workbook({"First & only": df, "Other": df.limit(0)}, path, {"answer": ["YES", "NO"]})
    assert sorted(tuple(r) for r in readers.workbook(spark, path, "First & only").collect()) == [("H1", "YES & no"), ("H2", "")]
    assert readers.workbook(spark, path, "Other").columns == ["item_id", "answer"] and readers.workbook(spark, path, "Other").count() == 0
    with pytest.raises(ValueError, match="no sheet"):
        readers.workbook(spark, path, "None")
    with pytest.raises(ValueError, match="no form"):
        writers.workbook({"a": df}, path, most=2)
    # another program's: texts shared, cells left out
    import zipfile

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>item_id</t></si><si><r><t>no</t></r><r><t>te</t></r></si></sst>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2"><v>1.5</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.workbook(spark, path, "S").collect()] == [("7", "", "1.5")]


def test_graph_files_and_traces(spark, tmp_path):
    rows = [(1, "do x", "imp", "ev", "YES", "YES", "Documentation Practices | Project Management and Governance"), (2, "do y", None, "e", "NO", "YES", "Documentation Practices"), (3, " do  y ", "i", "e", "NO", "YES", "Project Management and Governance|Security Best Practices and Legal Compliance"), (4, None, "i", "e", "NO", "NO", "Documentation Practices")]
    final = spark.createDataFrame(rows, "row_id long, actionable string, impact string, evidence string, sound string, precise string, category string")
    p = graph.payload(final, spark.createDataFrame([("do x", [1.0])], "actionable string, vector array<float>"))
    assert [(r.id, r.actionable, r.categories, r.embedding) for r in p["actionables"].orderBy("first_row").collect()] == [
        ("A_1", "do x", ["Documentation Practices", "Project Management and Governance"], "AACAPw=="),
        ("A_2", "do y", ["Documentation Practices", "Project Management and Governance", "Security Best Practices and Legal Compliance"], None),
    ]
    assert sorted((r.id, r["from"], r.to) for r in p["edges"].collect()) == [("E_1", "C_1", "A_1"), ("E_2", "C_2", "A_1"), ("E_3", "C_1", "A_2"), ("E_4", "C_2", "A_2"), ("E_5", "C_3", "A_2")]
    assert {(r.id, r.label) for r in p["categories"].collect()} == {("C_1", "Documentation Practices"[:20] + "…"), ("C_2", "Project Management a…"), ("C_3", "Security Best Practi…")}
    assert tuple(p["stats"].collect()[0]) == (3, 2, 3, 5)
    writers.graph_files(p, str(tmp_path / "g"), "Documentation Practices")
    kinds = {(r.chunk, r.kind): r.n for r in spark.read.text(str(tmp_path / "g")).groupBy("chunk", "kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("main", "node"): 2, ("main", "edge"): 2, ("main", "hub"): 3, ("main", "stats"): 1, ("project-management-and-governance", "edge"): 2, ("security-best-practices-and-legal-compliance", "edge"): 1}

    pool = spark.createDataFrame([("a||t", 0, "gpt", "do | x", "i", "e", 0.5), ("a||t", 1, "qwen", "do x", "i", "e", 0.7)], "article string, idx long, model_key string, text string, impact string, evidence string, confidence double")
    pairs = spark.createDataFrame([("a||t", 0, 1, 0.5)], "g string, i long, j long, sim double")
    members = spark.createDataFrame([("a||t", 0, 0, 0.5), ("a||t", 1, 0, 0.5)], "g string, i long, cluster long, degree double")
    full = pool.select(F.col("article").alias("g"), F.col("idx").alias("i"), "model_key", "text", "impact", "evidence", "confidence").join(members, ["g", "i"])
    kept = cluster.reconcile(full).withColumn("keep", F.lit(True))
    skipped = spark.createDataFrame([("a||t", "gemma", "message"), ("b", "gpt", "unparseable")], "article string, model_key string, skip_reason string")
    lines = writers.trace_lines(pool, pairs, members, kept, skipped)
    writers.trace(lines, str(tmp_path / "t"))
    text = {p.name: "".join(x.read_text() for x in sorted(p.glob("part-*"))).splitlines() for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert set(text) == {"file=a__t", "file=b"} and text["file=b"][:3] == ["# b", "## 0 Candidates", "No candidates: every model was skipped."]
    assert text["file=a__t"] == [
        "# a||t", "## 0 Candidates", r"| 0 | gpt | do \| x | i | e | 0.5 |", "| 1 | qwen | do x | i | e | 0.7 |", "| skipped | gemma | message |", "## 1 Similar pairs", "| 0 | 1 | 0.50 |", "## 2 Clusters", "| 0 | 0 | 0.5000 |",
        "| 0 | 1 | 0.5000 |", "## 3 Reconciliation", r"| 1 | 2/5 | gpt\|qwen | 0.6 | do \| x | i | e |", "## 4 Left out", "## 5 Final set", r"| 1 | 2/5 | gpt\|qwen | 0.6 | do \| x | i | e |",
    ]
    table = writers.latex_table(spark.createDataFrame([("a_b", 0.5)], "name string, share double"), {"name": "Name", "share": "Share %"}, "Shares & more", "tab:x")
    assert table.splitlines()[2:9] == [r"\caption{Shares \& more}", r"\label{tab:x}", r"\begin{tabular}{lr}", r"\hline", r"\textbf{Name} & \textbf{Share \%} \\", r"\hline", r"a\_b & 0.500 \\"]


def test_log_and_side_cars(spark, tmp_path):
    df = spark.createDataFrame([("gpt-4", "x"), ("Qwen3", "y")], "model_name string, category string")
    for _ in range(2):
        writers.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("family").count().where("count = 2").count() == 2
    writers.json_by_category(df, str(tmp_path / "j"))
    assert {p.name for p in (tmp_path / "j").iterdir() if p.is_dir()} == {"category_slug=x", "category_slug=y"}
    writers.replace_partitions(df, str(tmp_path / "r"), "model_name")
    writers.replace_partitions(df.where("category = 'x'").withColumn("category", F.lit("z")), str(tmp_path / "r"), "model_name")
    assert sorted(r.category for r in spark.read.parquet(str(tmp_path / "r")).collect()) == ["y", "z"]
    writers.numbered_files(df, str(tmp_path / "n"), "model_name", "category")
    assert spark.read.text(str(tmp_path / "n")).where("n = 1").collect()[0].value == "y"
    assert writers.latex_rows(df.orderBy("category"), ["model_name", "category"]) == "gpt-4 & x \\\\\nQwen3 & y \\\\"


def test_file_numbering_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    args = (str(src), str(tmp_path / "reg"), str(tmp_path / "cp"))
    for names in (["b.pdf", "a.pdf"], ["c.pdf", "x.txt"]):
        for n in names:
            (src / n).write_bytes(b"x")
        ingest.number_files(spark, *args).awaitTermination()
    got = sorted((r.sequence, r.path[-5:]) for r in spark.read.parquet(args[1]).collect())
    assert got == [(1, "a.pdf"), (2, "b.pdf"), (3, "c.pdf")]


def test_answers_are_appended_once(spark, tmp_path):
    row = ("v", "t", "gpt-4", "2025-01-01", "a")
    schema = "venue string, article_title string, model_name string, answered_at string, answer string"
    for k, rows in enumerate(([row, row], [row, ("v", "t", "gpt-4", "2025-01-01", "b")])):
        spark.createDataFrame(rows, schema).withColumn("logged_at", F.lit(f"2025-01-0{k + 1} 00:00:00").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.append_answers(spark, str(tmp_path / "in"), schema + ", logged_at timestamp", str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.answer for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["a", "b"]
