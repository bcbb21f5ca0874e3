"""Merging the workbooks of a folder as one job over their cells, however many files there are.

Cells are (sheet, row, col, value): one sheet a file, rows and columns from 0. Files go by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_header, strip
from ..sources.files import NA_TEXTS
from .agenda import headline_row
from .durable import keep
from .merge import CANONICAL_FROM, GROUPS, MAP_FROM, NUMBER, SOURCE, align, normalise_mapping, number_rows
from .similar import similar_pairs

OUTPUT = "汇总结果.xlsx"


def mergeable(files: DataFrame, output: str = OUTPUT) -> DataFrame:
    """The files of a folder that are merged: .xlsx in either case, no lock files, not the output itself."""
    low = F.lower("filename")
    return files.where(low.endswith(".xlsx") & ~low.startswith("~$") & (F.col("filename") != output))


def tidy_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, data): (sheet, col, name) of the columns that count, and (sheet, row, name, value) of the rows that do.

    The header row is found by ``headline_row``. Unnamed columns and the number column go; a second column of one name is
    ``name.1``. Empty and N/A texts are no values; rows without a first cell or without any value in a column that
    counts go, as does a first row that repeats the header.
    """
    cells = cells.join(headline_row(cells), "sheet")
    again = F.row_number().over(Window.partitionBy("sheet", "value").orderBy("col")) - 1
    heads = cells.where("row = header_row and value is not null and value <> ''").withColumn("again", again)
    named = heads.select("sheet", "col", F.when(F.col("again") == 0, F.col("value")).otherwise(F.concat("value", F.lit("."), F.col("again").cast("string"))).alias("name"))
    columns = named.where(~F.col("name").startswith("Unnamed") & (F.col("name") != NUMBER))
    body = cells.where((F.col("row") > F.col("header_row")) & F.col("value").isNotNull() & ~F.col("value").isin("", *NA_TEXTS)).drop("header_row")
    first_cell = body.where("col = 0").select("sheet", "row")
    data = body.join(first_cell, ["sheet", "row"], "left_semi").join(columns, ["sheet", "col"]).withColumn("value", strip(F.col("value")))
    least = first_cell.groupBy("sheet").agg(F.min("row").alias("row"))
    texts = data.join(least, ["sheet", "row"], "left_semi").select("sheet", "row", "col", "value")
    echo = columns.join(least, "sheet").join(texts, ["sheet", "row", "col"], "left").groupBy("sheet", "row").agg(F.bool_and(F.coalesce("value", F.lit("")) == strip(F.col("name"))).alias("echo")).where("echo")
    return columns, data.join(echo, ["sheet", "row"], "left_anti").select("sheet", "row", "name", "value")


def merge_folder(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, columns): (number, sheet, row, name, value) with rows numbered from 1 by file and row, and (place, name) in order of first sight.

    Columns are united by exact name. Files without a row add no columns. Absent values have no cell; ``wide`` fills them.
    """
    columns, data = tidy_cells(cells)
    data = keep(data, "merge-data")
    numbered = number_rows(data.select("sheet", "row").distinct(), "sheet", ["row"], "number")
    used = columns.join(data.select("sheet").distinct(), "sheet", "left_semi")
    first = used.groupBy("name").agg(F.min(F.struct("sheet", "col")).alias("at"))
    # as many rows as the output has columns
    placed = first.select(F.row_number().over(Window.orderBy("at")).alias("place"), "name")
    return data.join(numbered, ["sheet", "row"]).select("number", "sheet", "row", "name", "value"), placed


def wide(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """The merged table: the number, then a text column a name; the names of one table go over the driver."""
    names = [r["name"] for r in columns.orderBy("place").collect()]
    return cells.groupBy(F.col("number").alias(NUMBER)).pivot("name", names).agg(F.first("value")).na.fill("")


def _groups(spark) -> DataFrame:
    rows = [(w, k, g[0]) for k, g in enumerate(GROUPS) for w in g]
    words = spark.createDataFrame(rows, "word string, alias_group int, unified string")
    return F.broadcast(words.select(normalise_header(F.col("word")).alias("key"), "alias_group", "unified").dropDuplicates(["key"]))  # some dozens of fixed values


def leaders(headers: DataFrame, least: float = CANONICAL_FROM) -> DataFrame:
    """(sheet, col, header) -> (key, name, at): the unified headers of all files; ``at`` is where each was first seen.

    A header joins an earlier leader that it resembles, and else leads. Known headers go by the unified one of their group.
    The loop over all headers in order has the same outcome as this: of the distinct headers that are still open, those that resemble no
    earlier open one lead, and those that resemble an earlier leader have joined it; and so on with the rest. A round is two joins;
    there are as many as the longest chain of ever later likenesses, and no header passes through the driver.
    """
    keyed = headers.withColumn("key", normalise_header(F.col("header"))).where("key is not null and key <> ''")
    known = keyed.join(_groups(headers.sparkSession), "key", "left").withColumn("shown", F.coalesce("unified", "header"))
    place = F.struct("sheet", "col")
    nodes = known.groupBy(normalise_header(F.col("shown")).alias("key")).agg(F.min(place).alias("at"), F.min_by("shown", place).alias("name")).where("key <> ''")
    nodes = keep(nodes.select("key", "name", "at"), "leaders-nodes")
    later = similar_pairs(nodes.select(F.col("key").alias("a")), nodes.select(F.col("key").alias("b")), least)
    ats = nodes.select("key", "at")
    edges = later.where("a <> b").join(ats.toDF("a", "at_a"), "a").join(ats.toDF("b", "at_b"), "b").where("at_b < at_a").select(F.col("a").alias("later"), F.col("b").alias("earlier"))
    edges, open_ = keep(edges, "leaders-edges"), nodes.select("key")
    led = None
    while open_.head(1):
        live = edges.join(open_.toDF("later"), "later", "left_semi").join(open_.toDF("earlier"), "earlier", "left_semi")
        new = keep(open_.join(live.select(F.col("later").alias("key")).distinct(), "key", "left_anti"), "leaders-new")
        joined = live.join(new.toDF("earlier"), "earlier", "left_semi").select(F.col("later").alias("key")).distinct()
        led = new if led is None else led.union(new)
        open_ = keep(open_.join(new, "key", "left_anti").join(joined, "key", "left_anti"), "leaders-open")
    return nodes.join(led, "key", "left_semi") if led is not None else nodes


def mapping(headers: DataFrame, canonical: DataFrame, least: float = MAP_FROM) -> DataFrame:
    """(sheet, col, header, target): of each header by group, by equal key, by likeness (the first of equals), else itself.

    ``canonical`` is what ``leaders`` gives. Distinct headers are mapped once.
    """
    keyed = headers.withColumn("key", normalise_header(F.col("header")))
    keys = keyed.select("key").where("key <> ''").distinct()
    groups = _groups(headers.sparkSession).select("key", "alias_group")
    by_group = canonical.join(groups, "key").groupBy("alias_group").agg(F.min_by("name", "at").alias("by_group"))
    alias = keys.join(groups, "key").join(by_group, "alias_group").select("key", "by_group")
    same = canonical.select("key", F.col("name").alias("by_key"))
    # those of a group or with an equal key need no likeness; for most others there is a near one, and far ones need not be sought
    open_ = keys.join(alias, "key", "left_anti").join(same, "key", "left_anti").select(F.col("key").alias("a"))
    to = canonical.select(F.col("key").alias("b"))
    near = keep(similar_pairs(open_, to, max(least, CANONICAL_FROM)), "mapping-near")
    far = similar_pairs(open_.join(near.select("a"), "a", "left_anti"), to, least)
    near = near.union(far).join(canonical.select(F.col("key").alias("b"), "name", "at"), "b")
    best = near.groupBy(F.col("a").alias("key")).agg(F.max("ratio").alias("top")).join(near.withColumnRenamed("a", "key"), "key").where("ratio = top").groupBy("key").agg(F.min_by("name", "at").alias("by_ratio"))
    table = keys.join(alias, "key", "left").join(same, "key", "left").join(best, "key", "left").select("key", F.coalesce("by_group", "by_key", "by_ratio").alias("target"))
    return keyed.join(table, "key", "left").select("sheet", "col", "header", F.coalesce("target", "header").alias("target"))


def merge_alike(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``merge_folder``, with look-alike headers as one column; of two sources of a target the first with a value counts."""
    columns, data = tidy_cells(cells)
    data = keep(data, "merge-data")
    heads = columns.select("sheet", "col", F.col("name").alias("header"))
    canonical = leaders(heads)
    targets = mapping(heads, canonical)
    values = data.where("value <> ''").join(targets.withColumnRenamed("header", "name"), ["sheet", "name"])
    merged = values.groupBy("sheet", "row", "target").agg(F.min_by("value", "col").alias("value"))
    numbered = number_rows(data.select("sheet", "row").distinct(), "sheet", ["row"], "number")
    placed = canonical.select(F.row_number().over(Window.orderBy("at")).alias("place"), "name")  # as many rows as the output has columns
    return merged.join(numbered, ["sheet", "row"]).select("number", "sheet", "row", F.col("target").alias("name"), "value"), placed


def merge_tables(tables: list[tuple[str, DataFrame]], dedupe: bool = False) -> DataFrame:
    """Some DataFrames under unified headers, with a source column, and optionally distinct rows (sources differ, so within a file).

    Only their column names are clustered and go over the driver.
    """
    spark = tables[0][1].sparkSession
    heads = spark.createDataFrame([(k, c, h) for k, (_, df) in enumerate(tables) for c, h in enumerate(df.columns)], "sheet int, col int, header string")
    found = leaders(heads)
    canonical = [r["name"] for r in found.orderBy("at").collect()]
    targets: dict[int, dict[str, str]] = {}
    for r in mapping(heads, found).collect():
        targets.setdefault(r["sheet"], {})[r["header"]] = r["target"]
    parts = [
        align(df, normalise_mapping({h: targets[k][h] for h in df.columns}, canonical), canonical).withColumn(SOURCE, F.lit(name)) for k, (name, df) in enumerate(tables)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates() if dedupe else out
