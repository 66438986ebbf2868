"""Batched model calls over rows and values, resumable, behind a pluggable client.

A client is any object with ``ask(prompt) -> str``; a factory creates one per
task, so clients with connections work on executors. ``offline_client`` answers
deterministically without a network.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tabweave.functions.names import col, named
from tabweave.functions.text import json_mapping, strip_to_null
from tabweave.operators.clean import with_default
from tabweave.operators.pairs import ROW_ID, require
from tabweave.storage import materialised, numbered

LEAST_ROWS, MOST_ROWS, MOST_VALUES, FEW_ROWS = 35, 50, 100, 10
#: Prompts whose replies are saved together, and how often replies are saved at most: a large job saves equal shares of its prompts.
PER_COMMIT, COMMITS = 64, 50
PROMPT = "Answer with one JSON object for these rows.\n[rows]"


def pack(sizes: Iterable[int], least: int = LEAST_ROWS, most: int = MOST_ROWS) -> list[int]:
    """Batch number of each block: a batch below ``least`` rows takes the next block while the sum stays within ``most``."""
    out, size, batch = [], 0, 0
    for n in sizes:
        if out and size < least and size + n <= most:
            size += n
        else:
            batch, size = batch + 1, n
        out.append(batch)
    return out


def _blocks(sizes: DataFrame, least: int, most: int) -> DataFrame:
    """_g, first, last: the batch of a group's first block and of its last, from rows (_g, n) of group sizes.

    Groups are ranges in order. Whether a block joins the batch before it depends only on
    that batch's size, or on its being closed, so every range first says for each such state how
    many batches it opens and in which state it ends; these few numbers give each range its first state.
    """

    def step(state, n: int):
        """States and opened batches after a group, and whether its last block opened one; ``least`` stands for a closed batch."""
        full, rest = divmod(n, most)
        if full:
            joined, state = np.zeros(len(state), bool), np.full(len(state), least)
            return (np.full(len(state), min(rest, least)), np.full(len(state), full + 1), joined) if rest else (state, np.full(len(state), full), joined)
        joined = (state < least) & (state + rest <= most)
        return np.minimum(np.where(joined, state + rest, rest), least), np.where(joined, 0, 1), joined

    def summarise(batches):
        import pandas as pd
        from pyspark import TaskContext

        state, opened = np.arange(least + 1), np.zeros(least + 1, np.int64)
        for b in batches:
            for n in b["n"]:
                state, more, _ = step(state, int(n))
                opened += more
        yield pd.DataFrame({"_p": TaskContext.get().partitionId(), "ends": [state.tolist()], "opened": [opened.tolist()]})

    ordered = materialised(sizes.orderBy("_g"))
    ranges = ordered.mapInPandas(summarise, "_p int, ends array<long>, opened array<long>").orderBy("_p").collect()  # a row per partition
    begin, state, opened = {}, least, 0
    for r in ranges:
        begin[r["_p"]] = state, opened
        state, opened = r.ends[state], opened + r.opened[state]

    def number(batches):
        import pandas as pd
        from pyspark import TaskContext

        first, opened = begin[TaskContext.get().partitionId()]
        state = np.array([first])
        for b in batches:
            firsts, lasts = [], []
            for n in b["n"]:
                state, more, joined = step(state, int(n))
                firsts.append(opened if joined[0] else opened + 1)
                opened += int(more[0])
                lasts.append(opened)
            yield pd.DataFrame({"_g": b["_g"], "first": firsts, "last": lasts})

    return ordered.mapInPandas(number, f"_g {dict(sizes.dtypes)['_g']}, first long, last long")


def by_group(df: DataFrame, group: str, least: int = LEAST_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """``df`` with batch_id (from 1): groups in order, cut into blocks of ``most`` rows in row order, small ones packed together.

    Rows with a missing group get no batch and are left out. Rows are numbered over ranges of
    (group, row), so that a large group is spread over tasks.
    """
    rows = numbered(df.filter(col(group).isNotNull()), "_place", [col(group), ROW_ID])
    sizes = materialised(rows.groupBy(col(group).alias("_g")).agg(F.count("*").alias("n"), F.min("_place").alias("_start")))
    blocks = _blocks(sizes.select("_g", "n"), least, most).join(sizes, "_g").select("_g", "_start", F.col("first").alias("_first"), F.col("last").alias("_last"))
    block = F.floor((F.col("_place") - F.col("_start")) / most)
    out = rows.join(blocks, col(group) == F.col("_g"))
    return out.select(*named(df.columns), (F.least(F.col("_first") + block, F.col("_last"))).cast("long").alias("batch_id"))


def fixed(df: DataFrame, size: int = FEW_ROWS) -> DataFrame:
    """batch_id and local_id (1..size) for blocks of ``size`` rows in row order, by range partitions and their offsets."""
    out = numbered(df, "_place", [ROW_ID])
    return out.withColumns({"batch_id": F.floor(F.col("_place") / size) + 1, "local_id": (F.col("_place") % size + 1).cast("int")}).drop("_place")


def by_first_letter(df: DataFrame, column: str) -> DataFrame:
    return df.filter(strip_to_null(col(column)).isNotNull()).withColumn("batch_id", F.upper(F.substring(col(column), 1, 1)))


def row_json(columns: Sequence[str], group: Column | None = None) -> Column:
    """The row's non-blank trimmed values as a JSON object, with ``_row_id`` (and ``_group`` unless it is among the values)."""
    values = {c: strip_to_null(col(c).cast("string")) for c in columns}
    fields = [v.alias(c) for c, v in values.items()]
    if group is not None:
        fields.append(F.when(~F.coalesce(F.array_contains(F.array(*values.values()), group), F.lit(False)), group).alias("_group"))
    return F.to_json(F.struct(*fields, F.col(ROW_ID).alias("_row_id")))


def row_line(columns: Sequence[str]) -> Column:
    """Row id and values joined by blanks; missing values are empty."""
    return F.concat(F.col(ROW_ID).cast("string"), F.lit(" "), F.array_join(F.array(*(F.coalesce(col(c).cast("string"), F.lit("")) for c in columns)), " "))


def prompts(batched: DataFrame, columns: Sequence[str], template: str = PROMPT, group: str | None = None) -> DataFrame:
    """batch_id, prompt: ``Row id: json`` lines in row order, put into the template; rows without any value are left out."""
    values = [strip_to_null(col(c).cast("string")).isNotNull() for c in columns]
    batched = batched.filter(reduce(Column.__or__, values)) if values else batched
    line = F.concat(F.lit("Row "), F.col(ROW_ID).cast("string"), F.lit(": "), row_json(columns, col(group).cast("string") if group else None))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ROW_ID).alias("i"), line.alias("line")))), lambda x: x.line), "\n")
    return batched.groupBy("batch_id").agg(lines.alias("lines")).select("batch_id", F.replace(F.lit(template), F.lit("[rows]"), F.col("lines")).alias("prompt"))


class OfflineClient:
    """Deterministic replies: for each ``Row id: {...}`` line the first value's leading words and last word;
    where the prompt names a field, for each line that starts with a number its first word in capitals (a code) or its
    last word; for other lines their first word in capitals."""

    def ask(self, prompt: str) -> str:
        if field := re.search(r'"(product_code|product_category)"', prompt):
            lines = [(int(i), t.split()) for i, t in re.findall(r"^(\d+) (.*)$", prompt, re.M)]
            word = (lambda w: w[0].upper()) if field[1] == "product_code" else (lambda w: w[-1])
            return json.dumps({"rows": [{"row_id": i, field[1]: word(w) if w else ""} for i, w in lines]})
        rows = [json.loads(m) for m in re.findall(r"^Row [^:]*: (\{.*\})$", prompt, re.M)]
        if rows:
            texts = [(r["_row_id"], next((str(v) for k, v in r.items() if not k.startswith("_")), "")) for r in rows]
            return json.dumps({"rows": [{"row_id": i, "product_name": " ".join(t.split()[:3]), "manufacturer": t.split()[-1] if t.split() else ""} for i, t in texts]})
        values = [x for x in prompt.splitlines()[1:] if x.strip()]
        return json.dumps({x: x.split()[0].upper() for x in values})


def offline_client() -> OfflineClient:
    return OfflineClient()


def ask_all(asked: DataFrame, factory: Callable = offline_client, on_error: str = "skip") -> DataFrame:
    """batch_id, reply, error: one call per prompt; errors become rows, or raise if ``on_error`` is ``raise``."""

    def run(batches):
        import pandas as pd

        client = factory()
        for b in batches:
            replies, errors = [], []
            for p in b["prompt"]:
                try:
                    replies.append(client.ask(p))
                    errors.append(None)
                except Exception as e:  # a client may fail in any way; the batch's row says how
                    if on_error == "raise":
                        raise
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"batch_id": b["batch_id"], "reply": replies, "error": errors})

    return asked.mapInPandas(run, f"batch_id {dict(asked.dtypes)['batch_id']}, reply string, error string")


def extracted(replies: DataFrame, fields: Sequence[str] = ("product_name", "manufacturer")) -> DataFrame:
    """row_id, the fields, and batch_id from replies of the form {"rows": [{"row_id": ..., ...}]}."""
    schema = "struct<rows:array<struct<row_id:bigint," + ",".join(f"{f}:string" for f in fields) + ">>>"
    return replies.select("batch_id", F.inline(F.from_json("reply", schema).rows)).select("row_id", *fields, "batch_id")


def extract_resumable(df: DataFrame, group: str, columns: Sequence[str], folder: str, factory: Callable = offline_client, template: str = PROMPT, most_batches: int | None = None, on_error: str = "raise", per_commit: int = PER_COMMIT) -> DataFrame:
    """Extracts rows' fields; replies are saved in ``folder`` as they come, and batches that it holds are not asked again.

    A failed call raises, after the replies before it are saved (or is left out, if ``on_error`` is ``skip``).
    """
    require(df, group, *columns)
    asked = prompts(by_group(df, group), columns, template, group)
    asked = asked if most_batches is None else asked.filter(F.col("batch_id") <= most_batches)
    return extracted(_answered(asked, folder, factory, on_error, per_commit))


def join_results(df: DataFrame, results: DataFrame, fields: Sequence[str] = ("product_name", "manufacturer"), keep_all: bool = False) -> DataFrame:
    """Results by row id; of several for a row the last batch wins, unless all are kept."""
    last = results if keep_all else results.groupBy("row_id").agg(*(F.max_by(f, "batch_id").alias(f) for f in fields))
    return df.join(last.select(F.col("row_id").alias(ROW_ID), *fields), ROW_ID, "left")


#: Instructions for one field per row; ``[rows]`` and ``[vendors]`` are replaced.
CODE_PROMPT = """Find the product code (a model, part or stock number) in each numbered row; give an empty text if there is none.
Answer with one JSON object {"rows": [{"row_id": number, "product_code": text}]}.
[rows]"""
CATEGORY_PROMPT = """Name the category of the product in each numbered row; give an empty text if it is unclear.
Answer with one JSON object {"rows": [{"row_id": number, "product_category": text}]}.
[rows]"""
EXTRACT_PROMPT = """Name the product and its manufacturer in each row, a JSON object after the row's number. Use a vendor's name from this list where it fits:
[vendors]
Answer with one JSON object {"rows": [{"row_id": number, "product_name": text, "manufacturer": text}]}.
[rows]"""


def with_vendors(template: str, vendors: Sequence[tuple[str, Sequence[str]]]) -> str:
    """The template with a table of vendors and their aliases, one a line."""
    return template.replace("[vendors]", "\n".join(f"{name}: {', '.join(aliases)}" if aliases else name for name, aliases in vendors))


def lacking(config: dict[str, str | None], names: Sequence[str] = ("endpoint", "key", "deployment")) -> list[str]:
    """Names of settings that a client needs and the configuration lacks or leaves blank."""
    return [n for n in names if not str(config.get(n) or "").strip()]


def label_rows(df: DataFrame, columns: Sequence[str], field: str, template: str, folder: str, factory: Callable = offline_client, size: int = FEW_ROWS) -> DataFrame:
    """``df`` with ``field`` (added as an empty text if absent), asked for in batches of ``size`` rows numbered 1..size.

    Replies are saved in ``folder`` as they come, and batches that it holds are not asked again. A reply's numbers lead
    back to the rows; a row without an answer, or of a batch whose call failed, keeps its value.
    """
    rows = fixed(with_default(df, field), size)
    line = F.concat(F.col("local_id").cast("string"), F.lit(" "), F.array_join(F.array(*(F.coalesce(col(c).cast("string"), F.lit("")) for c in columns)), " "))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("local_id", line.alias("line")))), lambda x: x.line), "\n")
    asked = rows.groupBy("batch_id").agg(lines.alias("lines")).select("batch_id", F.replace(F.lit(template), F.lit("[rows]"), F.col("lines")).alias("prompt"))
    answers = extracted(_answered(asked, folder, factory), [field]).groupBy("batch_id", "row_id").agg(F.max(field).alias("_new"))
    answers = answers.withColumnRenamed("row_id", "local_id")
    return rows.join(answers, ["batch_id", "local_id"], "left").withColumn(field, F.coalesce("_new", col(field))).select(*named(df.columns), *(named([field]) if field not in df.columns else []))


def _answered(asked: DataFrame, folder: str, factory: Callable, on_error: str = "skip", per_commit: int = PER_COMMIT) -> DataFrame:
    """All replies in ``folder`` that aren't errors, after asking for the batches that it lacks.

    Prompts are written in files and read as a stream, whose micro-batches have about ``per_commit`` prompts, or more where there would be
    more than ``COMMITS`` of them otherwise (each costs about a second whatever its size); calls are spread over all
    tasks. Each micro-batch's replies are saved before the next one begins, under its own number, so that a repeated one replaces itself.
    With ``raise`` a failed call ends the run once its micro-batch is saved; the next run asks for what is lacking.
    """
    spark, run = asked.sparkSession, uuid.uuid4().hex
    replies, kind = f"{folder}/replies", dict(asked.dtypes)["batch_id"]
    schema = f"batch_id {kind}, reply string, error string, run string, commit long"
    store = spark._jvm.org.apache.hadoop.fs.Path(replies)
    found = lambda: spark.read.schema(schema).parquet(replies).filter("error IS NULL").select("batch_id", "reply", "error")
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        asked = asked.join(found().select("batch_id"), "batch_id", "left_anti")
    asked = materialised(asked.select("batch_id", "prompt"))
    n, tasks = asked.count(), spark.sparkContext.defaultParallelism
    if n:
        commits = min(COMMITS, -(-n // per_commit))
        at_once = min(tasks, -(-n // (commits * per_commit)))  # files of a micro-batch
        asked.repartition(commits * at_once).write.parquet(f"{folder}/asked/{run}")
        stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", at_once).parquet(f"{folder}/asked/{run}")
        spread = stream.repartition(tasks)

        def save(answers: DataFrame, number: int) -> None:
            at = f"{replies}/run={run}/commit={number}"
            answers.write.mode("overwrite").parquet(at)
            if on_error == "raise":
                failed = spark.read.parquet(at).filter("error IS NOT NULL").select("error").first()
                if failed is not None:
                    raise RuntimeError(f"a call failed: {failed.error}")

        query = ask_all(spread, factory).writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/log/{run}").trigger(availableNow=True).start()
        query.awaitTermination()
    return found() if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store) else spark.createDataFrame([], schema).select("batch_id", "reply", "error")


# --- value mappings ----------------------------------------------------------


def value_batches(df: DataFrame, column: str, size: int = MOST_VALUES) -> DataFrame:
    """batch_id, prompt of the sorted distinct non-blank values."""
    values = df.select(col(column).cast("string").alias("v")).filter(strip_to_null(F.col("v")).isNotNull()).distinct()
    numbered = fixed(values.withColumn(ROW_ID, F.col("v")), size)
    lines = F.array_join(F.array_sort(F.collect_list("v")), "\n")
    return numbered.groupBy("batch_id").agg(F.concat(F.lit("Map each value to a simple form.\n"), lines).alias("prompt"))


def mapping_from(replies: DataFrame) -> DataFrame:
    """original, simplified: mappings of all replies, later batches first in right."""
    pairs = replies.select("batch_id", F.explode(json_mapping(F.col("reply"))).alias("original", "simplified"))
    return pairs.groupBy("original").agg(F.max_by("simplified", "batch_id").alias("simplified")).orderBy("original")


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Adds ``<column>_simplified``: the mapped value, or the value itself."""
    m = mapping.select(F.col("original").alias("_o"), F.col("simplified").alias("_s")).dropDuplicates(["_o"])
    return df.join(m, col(column) == F.col("_o"), "left").withColumn(f"{column}_simplified", F.coalesce("_s", col(column))).drop("_o", "_s")


def simplify(df: DataFrame, column: str, folder: str, factory: Callable = offline_client, size: int = MOST_VALUES) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``<column>_simplified``, the mapping): distinct values are asked for in batches, replies parsed and merged, and the mapping applied.

    A batch whose call fails or whose reply can't be parsed leaves its values as they are.
    """
    mapping = materialised(mapping_from(_answered(value_batches(df, column, size), folder, factory)))
    return apply_mapping(df, column, mapping), mapping


def mapping_preview(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column), col(f"{column}_simplified")).distinct().orderBy(col(column))


def reduction(df: DataFrame, column: str) -> DataFrame:
    """Distinct values before and after a mapping, and the difference."""
    out = df.agg(F.count_distinct(col(column)).alias("before"), F.count_distinct(col(f"{column}_simplified")).alias("after"))
    return out.withColumn("fewer", F.col("before") - F.col("after")).withColumn("percent", F.coalesce(F.try_divide(F.col("fewer"), F.col("before")) * 100, F.lit(0.0)))


class OfflineSearch:
    """Deterministic results: a page for each word of the query."""

    def search(self, query: str, n: int) -> list[dict]:
        pages = [(w, f"https://example.org/{w.lower()}") for w in query.split()]
        return [{"id": f"{u}#{k}", "url": u, "title": w.upper(), "text": f"{w} in {query}", "author": w[:1], "published_date": f"2024-01-{k:02}"} for k, (w, u) in enumerate(pages[:n], 1)]


_ANSWER = "rank int, id string, url string, title string, published_date string, author string, text string, error string"


def web_table(factory: Callable = OfflineSearch, per_query: int = 2, retries: int = 2, per_second: float | None = None, wait: float = 0.5):
    """A table function of a query's text: its results by rank, from a search client with ``search(query, n) -> list of dicts``.

    A failed search is tried again after ever longer waits; after ``retries`` times it gives one row of rank 0 with its error. A
    task asks no more often than ``per_second`` times a second. Missing texts give no rows. Use it laterally:
    ``SELECT q.*, a.* FROM q, LATERAL web_answers(q.query) a`` after ``spark.udtf.register("web_answers", web_table(...))``.
    """
    fields = [f.split()[0] for f in _ANSWER.split(", ")][1:-1]

    class Answers:
        def __init__(self):
            self.client, self.last = factory(), 0.0

        def eval(self, query: str):
            if query is None or not query.strip():
                return
            for k in range(retries + 1):
                if per_second:
                    time.sleep(max(0.0, self.last + 1 / per_second - time.monotonic()))
                    self.last = time.monotonic()
                try:
                    found = self.client.search(query, per_query)[:per_query]
                except Exception as e:  # a client may fail in any way; the row says how
                    if k == retries:
                        yield (0, *[None] * len(fields), f"{type(e).__name__}: {e}")
                    else:
                        time.sleep(wait * 2**k)
                    continue
                for rank, r in enumerate(found, 1):
                    yield (rank, *((None if r.get(f) is None else str(r[f])) for f in fields), None)
                return

    return udtf(Answers, returnType=_ANSWER)


def web_answers(queries: DataFrame, factory: Callable = OfflineSearch, per_query: int = 2, **bounds) -> DataFrame:
    """``queries`` (with a column ``query``), each row with its results (see ``web_table``); rows without results are left out."""
    spark, name = queries.sparkSession, f"web_answers_{uuid.uuid4().hex}"
    spark.udtf.register(name, web_table(factory, per_query, **bounds))
    return spark.sql(f"SELECT q.*, a.* FROM {{q}} q, LATERAL {name}(q.query) a", q=queries)
