"""Detectors and assembly over the chunk streams of model calls, as batch jobs over ordered chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsheaf.functions.text import squeeze, strip
from docsheaf.settings import DEFAULTS, Settings

CONTINUATION = 512


def running_tokens(chunks: DataFrame) -> DataFrame:
    """Adds tokens: max(non-empty chunks, characters // 4) so far. chunks: call_id, seq, piece."""
    own = W.partitionBy("call_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    n = F.sum((F.length("piece") > 0).cast("long")).over(own)
    chars = F.sum(F.length("piece")).over(own)
    return chunks.withColumn("tokens", F.greatest(n, F.floor(chars / 4)))


def reasoning_budget(chunks: DataFrame, budget: int) -> DataFrame:
    """(call_id, seq, tokens): the chunk at which a call's running tokens exceed the budget; 0 is no budget."""
    if not budget:
        return running_tokens(chunks).select("call_id", "seq", "tokens").limit(0)
    over = running_tokens(chunks).filter((F.col("tokens") > budget) & (F.length("piece") > 0))
    return over.groupBy("call_id").agg(F.min(F.struct("seq", "tokens")).alias("x")).select("call_id", "x.*")


def complete_lines(chunks: DataFrame) -> DataFrame:
    """(call_id, pos, line): squeezed non-blank lines that a line feed has ended, numbered from 1."""
    whole = chunks.groupBy("call_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("t"))
    parts = F.split("t", "\n")
    lines = whole.select("call_id", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("n", "raw")).select("call_id", "n", squeeze(F.col("raw")).alias("line")).filter("line <> ''")
    return lines.select("call_id", F.row_number().over(W.partitionBy("call_id").orderBy("n")).alias("pos"), "line")


def repetition(lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(call_id, pos, length): the first line at which a block of up to repeat_lines lines has come repeat_count times
    in a row, for the shortest block that is long enough. lines: call_id, pos, line."""
    own = W.partitionBy("call_id").orderBy("pos")
    df, hits = lines, []
    for n in range(1, settings.repeat_lines + 1):
        same = F.coalesce(F.col("line") == F.lag("line", n).over(own), F.lit(False))
        df = df.withColumn(f"same_{n}", same.cast("int")).withColumn(f"miss_{n}", F.max(F.when(~same, F.col("pos"))).over(own.rowsBetween(W.unboundedPreceding, 0)))
        df = df.withColumn(f"chars_{n}", F.sum(F.length("line")).over(own.rowsBetween(-(n - 1), 0)))
        streak = F.col("pos") - F.coalesce(f"miss_{n}", F.lit(0))
        hits.append(F.when((streak >= n * (settings.repeat_count - 1)) & (F.col(f"chars_{n}") >= settings.repeat_min_chars), F.lit(n)))
    found = df.withColumn("length", F.coalesce(*hits)).filter("length is not null")
    return found.groupBy("call_id").agg(F.min(F.struct("pos", "length")).alias("x")).select("call_id", "x.*")


def split_think(chunks: DataFrame) -> DataFrame:
    """(call_id, reasoning, content) of tagged streams, wherever chunks cut the tags; an unclosed tag is reasoning."""
    whole = chunks.groupBy("call_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("t"))
    inner = F.regexp_extract_all("t", F.lit(r"(?is)<think>(.*?)(?:</think>|\z)"), F.lit(1))
    return whole.select("call_id", F.array_join(inner, "").alias("reasoning"), F.regexp_replace("t", r"(?is)<think>.*?(?:</think>|\z)", "").alias("content"))


def tool_json(tools: Column) -> Column:
    """Tool calls, array of (tool_index, name, id, args), as JSON in order of their index. Those without a name don't
    count; arguments that aren't JSON count as none."""
    named = F.filter(F.sort_array(tools), lambda x: x["name"].isNotNull())
    arguments = lambda x: F.coalesce(F.to_json(F.from_json(x["args"], "map<string,string>")), F.lit("{}"))
    return F.to_json(F.transform(named, lambda x: F.struct(x["name"].alias("name"), x["id"].alias("id"), arguments(x).alias("arguments"))))


def assemble_calls(chunks: DataFrame) -> DataFrame:
    """(call_id, text, reasoning, finish, tokens, tool_calls) of chunk rows.

    chunks: call_id, seq, content, reasoning, tool_index, tool_id, tool_name, tool_args, finish, tokens. A tool call has
    the first name, the last id and all arguments in order; arguments that aren't JSON count as none.
    """
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))))), lambda x: x["v"]), "")
    last = lambda c: F.max(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct("seq", F.col(c).alias("v"))))["v"]
    first = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("seq", F.col(c).alias("v"))))["v"]
    calls = chunks.groupBy("call_id").agg(strip(ordered("content")).alias("text"), strip(ordered("reasoning")).alias("reasoning"), last("finish").alias("finish"), last("tokens").alias("tokens"))
    parts = chunks.filter("tool_index is not null").groupBy("call_id", "tool_index").agg(first("tool_name").alias("name"), last("tool_id").alias("id"), ordered("tool_args").alias("args"))
    tools = parts.groupBy("call_id").agg(tool_json(F.collect_list(F.struct("tool_index", "name", "id", "args"))).alias("tool_calls"))
    return calls.join(tools, "call_id", "left").na.fill("[]", ["tool_calls"])


def throttle_progress(events: DataFrame, seconds: float = 1.0, key: str = "call_id", time: str = "at", tie: str = "seq") -> DataFrame:
    """The rows at least `seconds` after the last row kept, from the first one on; exact, by an ordered fold. Rows of one
    time are taken in order of `tie`."""
    from docsheaf.functions.folds import fold_by_key

    def fold(own: Iterator[dict]) -> Iterator[dict]:
        last = None
        for row in own:
            if last is None or row[time] - last >= seconds:
                last = row[time]
                yield row

    return fold_by_key(events, [key], [time, tie], fold, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema))


def reasoning_outcomes(first: DataFrame, second: DataFrame) -> DataFrame:
    """What became of calls whose reasoning was stopped: forced (the continuation answered) or failed.

    first: call_id, verdict, tokens. second (at most one row a call): call_id, error, tokens, repeated, answered.
    """
    both = first.filter("verdict <> ''").join(second.select("call_id", "error", F.col("tokens").alias("more"), "repeated", "answered"), "call_id", "left")
    failure = F.when(F.col("error").isNotNull(), "rejected").when(F.col("repeated"), "repeat").when(F.col("more") > CONTINUATION, "budget").when(~F.col("answered"), "empty")
    tokens = F.col("tokens") + F.coalesce("more", F.lit(0))
    return both.select("call_id", F.col("verdict").alias("forced"), failure.alias("runaway"), tokens.alias("reasoning_tokens"), failure.isNull().alias("answer_kept"))
