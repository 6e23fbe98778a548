"""Sources and sinks: loose records, chats, result files, code trees, shard audits, corpora with manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INSTRUCTION_KEYS = ("instruction", "query", "prompt", "problem", "question")
OUTPUT_KEYS = ("output", "response", "answer", "solution")
THINKING_KEYS = ("thinking", "reasoning_content")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def load_docs(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Records of a path as read: text lines (column text), JSON lines without malformed ones, or Parquet."""
    if fmt == "text":
        return spark.read.text(path).withColumnRenamed("value", "text").where(F.trim("text") != "")
    if fmt in ("json", "jsonl"):
        return spark.read.option("mode", "DROPMALFORMED").option("multiLine", fmt == "json").json(path)
    return spark.read.parquet(path)


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def turn_text(role: Column, content: Column) -> Column:
    """One turn between markers; a tool's answer is a user turn, an unknown role a user."""
    body = F.trim(F.coalesce(content, F.lit("")))
    framed = lambda who, x: F.concat(F.lit(f"{OPEN}{who}\n"), x, F.lit(f"\n{CLOSE}\n"))
    tool = F.concat(F.lit("<tool_response>\n"), body, F.lit("\n</tool_response>"))
    return F.when(body == "", "").when(role == "system", framed("system", body)).when(role.isin("tool", "function"), framed("user", tool)).when(role == "assistant", framed("assistant", body)).otherwise(framed("user", body))


def extract_text(df: DataFrame) -> DataFrame:
    """Adds ``training_text``: text, else instruction with thinking and output, with output, messages, else the first string."""
    instruction, output, thinking = (_first(df, k) for k in (INSTRUCTION_KEYS, OUTPUT_KEYS, THINKING_KEYS))
    both = lambda answer: F.concat(turn_text(F.lit("user"), instruction), F.lit(f"{OPEN}assistant\n"), answer, F.lit(f"\n{CLOSE}\n"))
    reasoned = both(F.concat(F.lit("<think>\n"), thinking, F.lit("\n</think>\n\n"), F.coalesce(output, F.lit(""))))
    choices = [_first(df, ("text",)), F.when(instruction.isNotNull() & thinking.isNotNull(), reasoned), F.when(instruction.isNotNull() & output.isNotNull(), both(output))]
    if "messages" in df.columns:
        chat = F.array_join(F.transform("messages", lambda m: turn_text(m["role"], m["content"])), "")
        choices.append(F.when(chat != "", chat))
    strings = tuple(f.name for f in df.schema.fields if f.dataType.simpleString() == "string")
    return df.withColumn("training_text", F.coalesce(*choices, _first(df, strings)))


def render_chat(conversations: DataFrame) -> DataFrame:
    """(conv_id, text): the turns of each conversation in order, empty ones left out."""
    turns = conversations.select("conv_id", "turn", turn_text(F.col("role"), F.col("text")).alias("part"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "").alias("text"))


ANSWER = "struct<task:string,question:string,answer:string,generated:string,correct:boolean>"
RESULT_SCHEMA = f"mode string, seed long, answers array<{ANSWER}>, summary map<string,struct<seed:long,answers:array<{ANSWER}>>>"


def flatten_answers(df: DataFrame, column: str = "value") -> DataFrame:
    """(mode, seed, task, question, answer, generated, correct) of result files (JSON strings), in either layout."""
    parsed = df.select(F.from_json(column, RESULT_SCHEMA).alias("r"))
    flat = parsed.where("r.answers is not null").select("r.mode", "r.seed", F.explode("r.answers").alias("a"))
    nested = parsed.where("r.summary is not null").select(F.explode("r.summary").alias("mode", "s")).select("mode", "s.seed", F.explode("s.answers").alias("a"))
    return flat.unionByName(nested).select("mode", "seed", "a.*")


def export_metrics(df: DataFrame, column: str = "value") -> dict[str, DataFrame]:
    """Long tables train, val, summary and items of run files (JSON strings with run, train, val, metrics, items)."""
    schema = "run string, train array<struct<step:long,loss:double>>, val array<struct<step:long,loss:double>>, metrics map<string,double>, items array<struct<question:string,correct:boolean>>"
    r = df.select(F.from_json(column, schema).alias("r")).select("r.*")
    curve = lambda name: r.select("run", F.explode(name).alias("x")).select("run", "x.step", "x.loss")
    return {"train": curve("train"), "val": curve("val"), "summary": r.select("run", F.explode("metrics").alias("metric", "value")), "items": r.select("run", F.posexplode("items").alias("item", "x")).select("run", "item", "x.question", "x.correct")}


def load_code(spark: SparkSession, root: str, suffix: str = ".py", least_chars: int = 1, most_files: int | None = None) -> DataFrame:
    """(path, text) of source files below ``root``, without version-control and environment folders, in order of path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    kept = files.where(~F.col("path").rlike(r"/\.(git|venv)/") & (F.char_length("text") >= least_chars))
    return kept.orderBy("path").limit(most_files) if most_files is not None else kept


def audit_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(name, status): ok, missing, extra, size or sha256, against a manifest (name, size, sha256)."""
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("own_size"), F.sha2("content", 256).alias("own_sha256"))
    status = F.when(F.col("own_size").isNull(), "missing").when(F.col("size").isNull(), "extra").when(F.col("size") != F.col("own_size"), "size").when(F.col("sha256") != F.col("own_sha256"), "sha256").otherwise("ok")
    return manifest.join(found, "name", "full_outer").select("name", status.alias("status"))


def write_corpus(df: DataFrame, path: str, category: str = "category", tokens: str = "n_tokens") -> DataFrame:
    """Writes the corpus partitioned by category and returns its manifest: records and tokens per category."""
    df.write.mode("overwrite").partitionBy(category).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(category).agg(F.count("*").alias("records"), F.sum(tokens).alias("tokens"))


def merge_results(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Both tables with the newer row wherever a key is in both."""
    both = old.withColumn("__age", F.lit(1)).unionByName(new.withColumn("__age", F.lit(0)))
    w = Window.partitionBy(*key).orderBy("__age")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__age")
