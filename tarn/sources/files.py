"""Readers and writers of the engine's text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.text import base_name
from tarn.plans.numbering import numbered_in_order
from tarn.plans.storage import stored


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """doc_id, name, text: a document for each file below path, numbered in the order of their paths.

    Numbers come from the paths alone, and no task orders all of them."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))
    names = numbered_in_order(files.select("name").distinct(), "name", name="doc_id")
    return files.join(names, "name").select("doc_id", "name", "text")


def read_patterns(path: str) -> list[str]:
    """Patterns of non-standard words, one a line in order of priority; blank lines and // comments are left out."""
    with open(path, encoding="utf-8") as f:
        lines = [line.strip() for line in f]
    return [line for line in lines if line and not line.startswith("//")]


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of lines `node;out1,out2,...`; repeated links once. Lines without ; are left out."""
    parts = spark.read.text(path).select(F.split("value", ";").alias("p")).where(F.size("p") >= 2)
    rows = parts.select(F.trim(F.col("p")[0]).try_cast("long").alias("src"), F.explode(F.split(F.col("p")[1], ",")).alias("dst"))
    return rows.select("src", F.trim("dst").try_cast("long").alias("dst")).where("dst is not null and src is not null").distinct()


def read_link_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node: all nodes of a link file, those without links too."""
    own = spark.read.text(path).select(F.trim(F.split("value", ";")[0]).try_cast("long").alias("node"))
    return own.union(read_links(spark, path).select("dst")).where("node is not null").distinct()


def read_numbered_links(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(links, nodes) of lines `node;out1,out2,...`, nodes being numbered from 0 by their first appearance, in lines and
    from left to right: links is src, dst (numbers; repeated links once), nodes is node, name. Files come in order of their
    paths; lines without ; are left out. Names are taken without blanks around them, and empty ones aren't nodes.

    Lines are not numbered by one task: a line's place is its file, the start of the split that holds it, and its order
    within that split; a node's number comes from the least place where it stands."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")]
    lines = spark.read.text(path).select(*place, F.split("value", ";", 2).alias("p")).where(F.size("p") == 2)
    outs = F.filter(F.transform(F.split(F.col("p")[1], ","), lambda x: F.trim(x)), lambda x: x != "")
    lines = stored(lines.select(F.struct("file", "split", "line").alias("place"), F.trim(F.col("p")[0]).alias("name"), outs.alias("outs")).where("name <> ''"), "lines")
    seen = lines.select("place", F.posexplode(F.concat(F.array("name"), "outs")).alias("nth", "name"))
    first = seen.groupBy("name").agg(F.min(F.struct("place.file", "place.split", "place.line", "nth")).alias("at"))
    nodes = stored(numbered_in_order(first.select("name", "at.*"), "file", "split", "line", "nth", name="node").select("node", "name"), "numbered-nodes")
    named = lines.select("name", F.explode("outs").alias("out")).distinct()
    ends = named.join(nodes.select("name", F.col("node").alias("src")), "name").join(nodes.select(F.col("name").alias("out"), F.col("node").alias("dst")), "out")
    return ends.select("src", "dst"), nodes


def out_degrees(edges: DataFrame) -> DataFrame:
    """node, out: out-degree of each node (0 for nodes that are only linked to)."""
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(out, nodes["node"] == out["src"], "left").select("node", F.coalesce("out", F.lit(0)).alias("out"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """node, title of lines `node;title`; the title is a path's last component."""
    cut = F.split("value", ";", 2)
    return spark.read.text(path).where(F.instr("value", ";") > 0).select(cut[0].try_cast("long").alias("node"), base_name(cut[1]).alias("title"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """node, score of lines `node: score[: more]`; decimal commas are read as points."""
    cut = F.split("value", r":\s+")
    rows = spark.read.text(path).select(cut.alias("p")).where(F.size("p") >= 2)
    return rows.select(F.trim(F.col("p")[0]).try_cast("long").alias("node"), F.regexp_replace(F.trim(F.col("p")[1]), ",", ".").try_cast("double").alias("score"))


def read_judgments(spark: SparkSession, path: str, with_run: bool = True) -> DataFrame:
    """run_id, rank, doc, rel of lines `run doc rel` (or `doc rel`, as run 1); // lines are left out; rank is the place
    of a line among those of its run. One judged list is small: a window orders its lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    rows = lines.where("trim(line) <> '' and not ltrim(line) like '//%'").select("line_no", F.split(F.trim("line"), r"\s+").alias("p"))
    base = 1 if with_run else 0
    rows = rows.where(F.size("p") >= base + 2).select("line_no", (F.col("p")[0].try_cast("int") if with_run else F.lit(1)).alias("run_id"), F.col("p")[base].alias("doc"), F.col("p")[base + 1].try_cast("int").alias("rel"))
    return rows.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("line_no")).alias("rank"), "doc", "rel")


def export_postings(postings: DataFrame) -> DataFrame:
    """term, entry: each posting as `docID:off,off,...,tf;` text, joined by term in order of documents."""
    entry = F.concat(F.col("doc_id"), F.lit(":"), F.concat_ws(",", F.col("offsets").cast("array<string>")), F.lit(","), F.col("tf").cast("double"))
    entries = postings.select("term", F.struct("doc_id", entry.alias("e")).alias("p")).groupBy("term").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return entries.select("term", F.array_join(F.col("p.e"), ";").alias("entry"))


def import_postings(lines: DataFrame) -> DataFrame:
    """term, doc_id, tf, offsets from export_postings rows; tf is counted anew from the offsets."""
    part = F.split("piece", ":")
    pieces = lines.select("term", F.explode(F.split("entry", ";")).alias("piece")).where("piece <> ''")
    numbers = F.split(part[1], ",")
    offsets = F.slice(numbers, 1, F.size(numbers) - 1).cast("array<int>")
    return pieces.select("term", part[0].try_cast("long").alias("doc_id"), F.size(numbers).try_cast("long").alias("n"), offsets.alias("offsets")).select("term", "doc_id", (F.col("n") - 1).alias("tf"), "offsets")


def score_lines(scores: DataFrame, value: str, pattern: str = "%s: %s") -> DataFrame:
    """value: a line for each score. "%.5g" of a text writer becomes round-trip text here unless a pattern says otherwise."""
    return scores.select(F.format_string(pattern, F.col("node").cast("string"), value).alias("value"))


def write_top(scores: DataFrame, value: str, path: str, k: int = 30, pattern: str = "%s: %s") -> None:
    """The k largest scores as lines `node: value`, in one file: k rows are few. pattern: as for score_lines, `%s: %.5g`
    for five significant digits."""
    best = scores.where(F.col(value) > 0).orderBy(F.desc(value), "node").limit(k)
    score_lines(best, value, pattern).coalesce(1).write.text(path)


def token_dump(tokens: DataFrame) -> DataFrame:
    """value: a token a line, in order of documents and positions."""
    return tokens.select("doc_id", F.posexplode("toks").alias("pos", "value")).orderBy("doc_id", "pos").select("value")
