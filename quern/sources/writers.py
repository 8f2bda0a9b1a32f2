"""Sinks: tables, logs by model family, JSON side-cars, rendered tables."""

from __future__ import annotations

import re
import zipfile
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quern.functions import text as X
from quern.operators.graph import chunk_edges, chunks


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str, model: str = "model_name") -> None:
    """Appends to a log partitioned by model family; nothing is overwritten."""
    df.withColumn("family", X.family(F.col(model))).write.mode("append").partitionBy("family").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that df has rows of, and no others: the result of one model at a time."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def json_by_category(df: DataFrame, path: str, category: str = "category") -> None:
    df.withColumn("category_slug", X.slug(F.col(category))).write.mode("overwrite").partitionBy("category_slug").json(path)


def json_lines(df: DataFrame, path: str, record: Column) -> None:
    df.select(record.alias("value")).write.mode("overwrite").text(path)


def numbered_files(df: DataFrame, path: str, order: str, body: str) -> None:
    """One text per file in folders n=1, 2, ... in the order of a unique column."""
    from quern.operators.metrics import numbered

    numbered(df, order, "n").select("n", body).write.mode("overwrite").partitionBy("n").text(path)


def graph_files(payload: dict[str, DataFrame], path: str, default: str) -> None:
    """The graph as JSON side-cars in folders chunk=main and one a category's slug: nodes, edges, and for main all hubs and the
    stats. An actionable lies in main if the default category has it, else in each of its categories' chunks."""
    e = payload["edges"]
    name = F.when(F.col("chunk") == "main", "main").otherwise(X.slug(F.col("chunk")))
    nodes = chunks(e, default).join(payload["actionables"], "actionable")
    parts = [
        nodes.select("chunk", F.lit("node").alias("kind"), F.to_json(F.struct(*[c for c in nodes.columns if c != "chunk"])).alias("value")),
        chunk_edges(e, default).select("chunk", F.lit("edge").alias("kind"), F.to_json(F.struct("id", "from", "to")).alias("value")),
        payload["categories"].select(F.lit("main").alias("chunk"), F.lit("hub").alias("kind"), F.to_json(F.struct("id", "label", "category")).alias("value")),
        payload["stats"].select(F.lit("main").alias("chunk"), F.lit("stats").alias("kind"), F.to_json(F.struct("*")).alias("value")),
    ]
    whole = reduce(DataFrame.unionByName, parts)
    whole.withColumn("chunk", name).write.mode("overwrite").partitionBy("chunk", "kind").text(path)


def latex_rows(df: DataFrame, columns: list[str], most: int = 1000) -> str:
    """The rows of a small summary as lines of a LaTeX table; refuses more than `most`."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows is no summary")
    return "\n".join(" & ".join("" if x is None else f"{x:.3f}" if isinstance(x, float) else _escaped(x) for x in r) + r" \\" for r in rows)


def _escaped(x) -> str:
    return re.sub(r"([&%_#])", r"\\\1", str(x))


def latex_table(df: DataFrame, columns: dict[str, str], caption: str, label: str, most: int = 1000) -> str:
    """A small summary as a whole LaTeX table; columns: shown heading by column, numbers to the right."""
    numbers = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    heads = " & ".join(rf"\textbf{{{_escaped(h)}}}" for h in columns.values())
    lines = [r"\begin{table}", r"\centering", rf"\caption{{{_escaped(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{''.join('r' if c in numbers else 'l' for c in columns)}}}", r"\hline", heads + r" \\", r"\hline"]
    return "\n".join([*lines, latex_rows(df, list(columns), most), r"\hline", r"\end{tabular}", r"\end{table}"])


def trace_lines(pool: DataFrame, pairs: DataFrame, reconciled_members: DataFrame, kept: DataFrame, skipped: DataFrame, models: int = 5) -> DataFrame:
    """(article, stage, place, part, line) of the Markdown trace of each article, a row a line:
    0 the candidates and the skipped answers, 1 the pairs above the threshold, 2 the clusters' members, 3 what became of each
    cluster, 4 the clusters that were left out, 5 the rows that stay. An article without candidates has a note instead.
    pool: article, idx, model_key, text, impact, evidence, confidence; pairs: g, i, j, sim; members: g, i, cluster, degree;
    kept: as from reconcile with all supports, and a column keep; skipped: article, model_key, skip_reason."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|"))
    row = lambda *cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))

    def part(df: DataFrame, article: str, stage: int, place, line, second=None) -> DataFrame:
        return df.select(F.col(article).alias("article"), F.lit(stage).alias("stage"), place.cast("long").alias("place"), (F.lit(0) if second is None else second).cast("long").alias("part"), line.alias("line"))

    articles = pool.select("article").unionByName(skipped.select("article")).distinct()
    heads = ["Candidates", "Similar pairs", "Clusters", "Reconciliation", "Left out", "Final set"]
    known = pool.select("article").distinct()
    parts = [part(articles, "article", k, F.lit(-2), F.lit(f"## {k} {h}")) for k, h in enumerate(heads)]
    parts += [part(articles, "article", -1, F.lit(0), F.concat(F.lit("# "), F.coalesce("article", F.lit(""))))]
    parts += [part(articles.join(known, "article", "left_anti"), "article", 0, F.lit(-1), F.lit("No candidates: every model was skipped."))]
    parts += [part(pool, "article", 0, F.col("idx"), row(*map(cell, ("idx", "model_key", "text", "impact", "evidence", "confidence"))))]
    numbered_ = skipped.withColumn("_p", F.xxhash64("model_key", "skip_reason").bitwiseAND((1 << 40) - 1) + (1 << 41))
    parts += [part(numbered_, "article", 0, F.col("_p"), row(F.lit("skipped"), cell("model_key"), cell("skip_reason")))]
    parts += [part(pairs, "g", 1, F.col("i"), row(F.col("i").cast("string"), F.col("j").cast("string"), F.format_string("%.2f", "sim")), F.col("j"))]
    parts += [part(reconciled_members, "g", 2, F.col("cluster"), row(F.col("cluster").cast("string"), F.col("i").cast("string"), F.format_string("%.4f", "degree")), F.col("i"))]
    done = lambda df, stage: part(df, "article", stage, F.col("cluster_id"), row(F.col("cluster_id").cast("string"), F.concat(F.col("support").cast("string"), F.lit(f"/{models}")), cell("models_present"), cell("avg_confidence"), cell("actionable"), cell("impact"), cell("evidence")))
    parts += [done(kept, 3), done(kept.where("not keep"), 4), done(kept.where("keep"), 5)]
    return reduce(DataFrame.unionByName, parts)


def trace(lines: DataFrame, path: str) -> None:
    """Writes the trace as text in a folder per article. Lines are sorted on disk, never gathered in memory; an article's
    file name is its safe name, and articles that share one share a folder, one after the other."""
    named = lines.withColumn("file", X.safe_name(F.coalesce("article", F.lit("none"))))
    named.repartition("file").sortWithinPartitions("file", "article", "stage", "place", "part").select("file", "line").write.mode("overwrite").partitionBy("file").text(path)


def workbook(sheets: dict[str, DataFrame], path: str, choices: dict[str, list[str]] | None = None, most: int = 10_000) -> None:
    """Small frames as the sheets of one workbook file, written by the driver; a column in `choices` gets a list to choose
    from. A frame of more than `most` rows is refused."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    space, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n, df in enumerate(sheets.values(), 1):
            rows = df.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"a sheet of more than {most} rows is no form")
            cell = lambda x: f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if x is None else str(x))}</t></is></c>'
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [df.columns, *rows])
            rules = "".join(
                f'<dataValidation type="list" allowBlank="1" sqref="{c}2:{c}{len(rows) + 1}"><formula1>{escape(chr(34) + ",".join(choices[name]) + chr(34))}</formula1></dataValidation>'
                for c, name in ((_letters(k), name) for k, name in enumerate(df.columns)) if choices and name in choices
            )
            rules = f"<dataValidations>{rules}</dataValidations>" if rules else ""
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'{head}<worksheet xmlns="{space}"><sheetData>{body}</sheetData>{rules}</worksheet>')
        listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{space}" xmlns:r="{link}"><sheets>{listed}</sheets></workbook>')
        package = "http://schemas.openxmlformats.org/package/2006"
        kind = lambda x: f"{link}/{x}"
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{n}" Type="{kind("worksheet")}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kind("officeDocument")}" Target="xl/workbook.xml"/></Relationships>')
        main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{main}.worksheet+xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/>{parts}</Types>')


def _letters(k: int) -> str:
    """A column's letters, from A for 0."""
    return (_letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)
