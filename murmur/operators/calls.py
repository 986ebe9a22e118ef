"""Model calls over rows: providers by name, one retry policy, fallback, records that never raise. Providers are plain
functions (model_id, system, user) -> text; those of this module need no network."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.text import RETRYABLE

Provider = Callable[[str, str, str], str]


def echo(model_id: str, system: str, user: str) -> str:
    """A deterministic stand-in: the first words of the prompt."""
    return f"[{model_id}] " + " ".join(user.split()[:12])


PROVIDERS: dict[str, Provider] = {"echo": echo}


@dataclass(frozen=True)
class Retry:
    """Tries with growing waits (by a factor, or by a step where one is given); a delay named in the error counts instead, and
    `more` seconds are added to either."""

    base: float = 20.0
    factor: float = 2.0
    tries: int = 3
    sleep: Callable[[float], None] = time.sleep
    step: float = 0.0
    more: float = 0.0

    def call(self, f: Callable[[], str]) -> str:
        wait = self.base
        for left in range(self.tries - 1, -1, -1):
            try:
                return f()
            except Exception as e:  # whatever a provider raises
                said = str(e).lower()
                if not left or not any(s in said for s in RETRYABLE):
                    raise
                named = re.search(r"retry_delay\s*\{\s*seconds:\s*(\d+)", said)
                self.sleep((float(named[1]) if named else wait) + self.more)
                wait = wait + self.step if self.step else wait * self.factor
        raise AssertionError


# The retry policies of web jobs, of second-level summaries, of their chunked form, and of recognising images.
WEB, LEVEL2, CHUNKED, IMAGES = Retry(20, 2.0, 3), Retry(30, 2.0, 3), Retry(20, 1.7, 4), Retry(10, tries=4, step=10, more=1)
RECORD = "summary string, status string, error string, input_tokens int, output_tokens int, latency_seconds double"


def run_models(rows: DataFrame, providers: dict[str, Provider] | None = None, retry: Retry | None = None, system: str = "", most_parallel: int | None = None) -> DataFrame:
    """rows (provider, model_id, prompt, ...) with a record beside each. most_parallel bounds the tasks that call at once."""
    known, policy = providers or PROVIDERS, retry or Retry(0, 1, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, m, prompt in zip(batch["provider"], batch["model_id"], batch["prompt"], strict=True):
                began = time.time()
                try:
                    text = re.sub(r"(?s)<think>.*?</think>", "", policy.call(lambda p=p, m=m, prompt=prompt: known[p](m, system, prompt))).strip()
                    out.append((text, "success", None, len(prompt.split()), len(text.split()), time.time() - began))
                except Exception as e:  # a record for every row
                    out.append((None, "error", f"{type(e).__name__}: {e}", None, None, time.time() - began))
            record = pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])
            yield pd.concat([batch.reset_index(drop=True), record.astype({"input_tokens": "Int32", "output_tokens": "Int32"})], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + RECORD
    return (rows.repartition(most_parallel) if most_parallel else rows).mapInPandas(run, schema)


def first_that_parses(*chain: Callable[[list[str]], list[str] | None]) -> Callable[[list[str]], list[str]]:
    """The first link of a chain whose answer is a list; the input where none is."""

    def run(items: list[str]) -> list[str]:
        for f in chain:
            try:
                if (out := f(items)) is not None:
                    return out
            except Exception:  # the next link answers
                continue
        return items

    return run


def guarded(before: list[str], after: list[str], most_removed: float = 0.5) -> list[str]:
    """after, unless it removes more than that share."""
    return after if len(after) >= len(before) * (1 - most_removed) else before


def merged(items: list[str], *chain: Callable[[list[str]], list[str]], least: int = 5, most_removed: float = 0.5) -> list[str]:
    """A semantic merge of a whole list: the first link of the chain whose answer is neither empty nor removes more than that
    share; lists of up to `least` items, and those that no link answers for, stay as they are."""
    if len(items) > least:
        for f in chain:
            try:
                out = f(items)
            except Exception:  # the next link answers
                continue
            if out and guarded(items, out, most_removed) is out:
                return out
    return items


def clean_run(items: DataFrame, group: str, batch_chain: tuple, merge_chain: tuple, batch: int = 30, lengths: tuple[int, int] = (30, 200)) -> DataFrame:
    """(group, id, text): the whole cleaning of each group's items (group, pos, text): batches cleaned by a chain of calls (its
    first list that parses; a batch that none answers for is dropped), fuzzy dedup, a window of lengths, a guarded merge of what
    is left, and dedup and lengths once more. Batches are cleaned apart, wherever they are; only the cleaned list of a group
    comes together, as its merge is one call."""
    from murmur.operators.dedup import dedup

    kind = items.schema[group].dataType.simpleString()

    def cleaned(d: pd.DataFrame) -> pd.DataFrame:
        rows = d.sort_values("pos")
        out = next((x for f in batch_chain if (x := _tried(f, rows["text"].tolist()))), [])
        return pd.DataFrame({group: rows[group].iloc[0], "pos": rows["pos"].iloc[0] + pd.RangeIndex(len(out)) / (len(out) + 1), "text": out})

    def folded(d: pd.DataFrame) -> pd.DataFrame:
        rows = d.sort_values("kept_pos")
        out = merged(rows["text"].tolist(), *merge_chain)
        return pd.DataFrame({group: rows[group].iloc[0], "pos": range(1, len(out) + 1), "text": out})

    def unique(rows: DataFrame) -> DataFrame:
        numbered = rows.select(group, F.row_number().over(Window.partitionBy(group).orderBy("pos")).cast("long").alias("pos"), "text")
        return dedup(numbered, "longest", group).where(F.length("text").between(*lengths))

    numbered = items.withColumn("__b", F.floor((F.row_number().over(Window.partitionBy(group).orderBy("pos")) - 1) / batch))
    first = unique(numbered.groupBy(group, "__b").applyInPandas(lambda d: cleaned(d), f"{group} {kind}, pos double, text string"))
    last = unique(first.select(group, "kept_pos", "text").groupBy(group).applyInPandas(folded, f"{group} {kind}, pos long, text string"))
    return last.select(group, F.row_number().over(Window.partitionBy(group).orderBy("kept_pos")).alias("id"), "text")


def _tried(f: Callable[[list[str]], list[str] | None], items: list[str]) -> list[str] | None:
    try:
        return f(items)
    except Exception:  # the next link answers
        return None


#: The most models of a run: their table goes to every task.
MODELS = 1000


def _for_each(prompts: DataFrame, models: DataFrame) -> DataFrame:
    """Every prompt for every model, which is what a run asks for; a table of more than MODELS models is an error."""
    if models.limit(MODELS + 1).count() > MODELS:
        raise ValueError(f"a run has {MODELS} models at most")
    return prompts.crossJoin(F.broadcast(models))


def summarize(chunks: DataFrame, models: DataFrame, group: str, batch: int = 20, **kw) -> DataFrame:
    """Two levels: each chunk by each model, then the successful summaries of a model, in batches, by the same model."""
    one = run_models(_for_each(chunks.select(group, "pos", F.col("text").alias("prompt")), models), **kw)
    good = one.where((F.col("status") == "success") & (F.trim("summary") != "")).withColumn("batch", F.floor(F.col("pos") / batch))
    return run_models(_prompts(good, "pos", group, "provider", "model_id", "batch"), **kw)


def _prompts(summaries: DataFrame, order: str, *by: str) -> DataFrame:
    """One prompt for each group of summaries: numbered in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "summary")))
    text = F.array_join(F.transform(ordered, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.trim(x["summary"]))), "\n\n")
    return summaries.groupBy(*by).agg(text.alias("prompt"), F.count("*").alias("parts"))


def summarize_in_three(chunks: DataFrame, models: DataFrame, group: str, batch: int = 20, least: int = 20, **kw) -> DataFrame:
    """Three levels: chunks, batches of their successful summaries (numbered anew, so that batches are full), and one summary
    of each model over its batches. Models with fewer than `least` good summaries are left out; where a batch fails the
    model's record is an error without a last call."""
    one = run_models(_for_each(chunks.select(group, "pos", F.col("text").alias("prompt")), models), **kw)
    keys = [group, "provider", "model_id"]
    w = Window.partitionBy(*keys)
    good = one.where((F.col("status") == "success") & (F.trim("summary") != ""))
    good = good.withColumns({"n": F.count("*").over(w), "batch": F.floor((F.row_number().over(w.orderBy("pos")) - 1) / batch)}).where(F.col("n") >= least)
    two = run_models(_prompts(good, "pos", *keys, "batch"), **kw)
    whole = two.withColumn("failed", F.max((F.col("status") != "success").cast("int")).over(w))
    three = run_models(_prompts(whole.where("failed = 0").select(*keys, "batch", "summary"), "batch", *keys), **kw)
    names = [c.split()[0] for c in RECORD.split(", ")]
    broken = whole.where("failed = 1").select(*keys).distinct().select(*keys, F.lit("").alias("summary"), F.lit("error").alias("status"), F.lit("a batch is incomplete").alias("error"))
    return three.select(*keys, *names).unionByName(broken, allowMissingColumns=True)
