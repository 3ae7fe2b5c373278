"""Answers, citations, locators, batches and snapshots around retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_locators(blocks: DataFrame, part: str) -> DataFrame:
    """(part, kind, page_from, page_to) over blocks' places: their span, or NULL if kinds or sheets differ."""
    g = blocks.groupBy(part).agg(F.count_distinct("kind").alias("k"), F.min("kind").alias("kind"), F.min("page_from").alias("page_from"), F.max("page_to").alias("page_to"))
    one = F.col("k") == 1
    return g.select(part, *[F.when(one, F.col(c)).alias(c) for c in ("kind", "page_from", "page_to")])


def scrub_markers(answer: Column, n: Column) -> Column:
    """The answer without ``[k]`` marks whose k is not 1 to n."""
    parts = F.split(answer, r"(?=\[[0-9]+\])")
    keep = lambda p: F.regexp_extract(p, r"^\[([0-9]+)\]", 1)
    tidy = lambda p: F.when((keep(p) == "") | F.coalesce(F.try_to_number(keep(p), F.lit("999999999")).cast("long").between(1, n), F.lit(False)), p).otherwise(F.regexp_replace(p, r"^\[[0-9]+\]", ""))
    return F.array_join(F.transform(parts, tidy), "")


def parse_answer(raw: Column, n: Column) -> Column:
    """(answer, citations, degraded) of a model's response: JSON, in a fence or not, else the text itself without citations.

    Citations are whole numbers from 1 to n, once each; marks of others are taken out of the answer.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), "^```(?i:json)?\\s*\\n?", ""), "\\n?```$", "")
    body = lambda v: F.when(F.schema_of_variant(F.try_variant_get(v, "$.answer", "variant")) == "STRING", F.try_variant_get(v, "$.answer", "string"))
    first, second = F.try_parse_json(raw), F.try_parse_json(bare)
    v = F.when(body(first).isNotNull(), first).otherwise(second)
    answer = body(v)
    kind = lambda c: F.schema_of_variant(c).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    listed = F.coalesce(F.try_variant_get(v, "$.citations", "array<variant>"), F.array().cast("array<variant>"))
    whole = F.transform(F.filter(listed, kind), lambda c: F.try_variant_get(c, "$", "double"))
    cites = F.array_distinct(F.transform(F.filter(whole, lambda c: (c == F.floor(c)) & c.between(1, n)), lambda c: c.cast("int")))
    good = answer.isNotNull()
    return F.struct(scrub_markers(F.coalesce(answer, raw), n).alias("answer"), F.when(good, cites).otherwise(F.array().cast("array<int>")).alias("citations"), (~good).alias("degraded"))


def clamp_citations(cites: Column, n: Column) -> Column:
    return F.array_distinct(F.filter(cites, lambda c: c.between(1, n)))


def grade_citations(rows: DataFrame) -> DataFrame:
    """Rows (qid, cited, must, must_not, answer, forbidden) with missing and forbidden citations, leaks, and pass."""
    missing, wrong = F.array_except("must", "cited"), F.array_intersect("must_not", "cited")
    leak = F.exists("forbidden", lambda w: F.contains(F.lower("answer"), F.lower(w)))
    return rows.select("qid", F.size(missing).alias("missing"), F.size(wrong).alias("wrong"), leak.alias("leaked"), ((F.size(missing) == 0) & (F.size(wrong) == 0) & ~leak).alias("passed"))


def acl_as_declared(pages: DataFrame) -> DataFrame:
    """Whether each page's list (acl) equals the declared one (declared) as a set."""
    same = (F.size(F.array_except("acl", "declared")) == 0) & (F.size(F.array_except("declared", "acl")) == 0)
    return pages.select("page_id", same.alias("as_declared"))


def completeness(rows: DataFrame, questions: DataFrame, configs: DataFrame) -> DataFrame:
    """(config, missing): how many questions each configuration has no row for."""
    want = configs.crossJoin(questions.select("qid"))  # few configurations, by the stated questions
    return want.join(rows.select("config", "qid").distinct(), ["config", "qid"], "left_anti").groupBy("config").agg(F.count("*").alias("missing"))


def redact(params: Column, declared: tuple[str, ...]) -> Column:
    """What may be logged of a parameter map: declared names, how many others, and its size rounded up to a kilobyte."""
    names = F.map_keys(params)
    size = F.octet_length(F.to_json(params))
    return F.struct(F.array_sort(F.array_intersect(names, F.array(*map(F.lit, declared)))).alias("declared"), F.size(F.array_except(names, F.array(*map(F.lit, declared)))).alias("unknown"), (F.ceil(size / 1024) * 1024).alias("bytes"))


def lock_state(heartbeat: Column, now: Column, ttl_minutes: int, released: Column) -> Column:
    age = F.unix_timestamp(now) - F.unix_timestamp(heartbeat)
    return F.when(released, "free").when(heartbeat.isNull(), "dead").when(age > 60 * ttl_minutes, "expired").otherwise("live")


def snapshot(top: DataFrame) -> DataFrame:
    """(qid, text): ``n. slug#ord`` lines of each question's list, for a golden file."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "slug", F.lit("#"), F.col("ord").cast("string"))
    g = top.select("qid", "rank", line.alias("line")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return g.select("qid", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def read_snapshot(lines: DataFrame, text: str = "text") -> DataFrame:
    rows = lines.select("qid", F.explode(F.split(text, "\n")).alias("line"))
    part = lambda k: F.regexp_extract("line", r"^([0-9]+)\. (.*)#([0-9]+)$", k)
    return rows.select("qid", part(1).cast("int").alias("rank"), part(2).alias("slug"), part(3).cast("int").alias("ord"))


def plan_batches(items: DataFrame, most_items: int = 64, most_tokens: int = 20_000) -> DataFrame:
    """(part, seq, batch): runs of each part's items (part, seq, tokens), in order, under both limits; one too heavy item goes alone."""
    return _packed(items.select("part", "seq", "tokens"), most_items, most_tokens, False)


def plan_updates(counts: DataFrame, most_rows: int = 2_000) -> DataFrame:
    """(part, seq, batch): pages' row counts (part, seq, tokens) packed into statements of so many rows; pages without rows open none."""
    return _packed(counts.select("part", "seq", "tokens"), None, most_rows, True)


def _packed(items: DataFrame, most_items: int | None, most: int, weighed: bool) -> DataFrame:
    """A fold that streams each part's rows in order and holds three numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k, n, s = object(), 0, 0, 0
        for rows in batches:
            out = []
            for part, w in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if part != now:
                    now, k, n, s = part, 0, 0, 0
                if (most_items and n >= most_items) or ((s if weighed else n) > 0 and s + (w or 0) > most):
                    k, n, s = k + 1, 0, 0
                n, s = n + 1, s + (w or 0)
                out.append(k)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.int64())], ["part", "seq", "batch"])

    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    typed = items.select(F.col("part").cast("string"), F.col("seq").cast("long"), F.col("tokens").cast("long"))
    return typed.repartition(width, "part").sortWithinPartitions("part", "seq").mapInArrow(run, "part string, seq long, batch long")


def ingest_outcomes(files: DataFrame, known: DataFrame) -> DataFrame:
    """(seq, outcome) of a batch of files (seq, sha, verdict): rejected, duplicate of an earlier one or of a known one, or ingested."""
    first = files.where("verdict = 'ok'").groupBy("sha").agg(F.min("seq").alias("first"))
    j = files.join(first, "sha", "left").join(known.select("sha").distinct().withColumn("_known", F.lit(True)), "sha", "left")
    out = F.when(F.col("verdict") != "ok", F.concat(F.lit("rejected:"), "verdict")).when(F.col("_known"), "duplicate").when(F.col("first") < F.col("seq"), "duplicate_in_batch").otherwise("ingested")
    return j.select("seq", out.alias("outcome"))


def table_variant(title: Column, date: Column, body: Column) -> Column:
    """A text with its metadata as a header line."""
    return F.concat_ws("\n\n", F.concat_ws(" | ", title, date.cast("string")), body)


def token_cost(tokens_in: Column, tokens_out: Column, model: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Cost in units per million tokens; an unknown model is an error."""
    out = F.raise_error(F.concat(F.lit("unknown model: "), model)).cast("double")
    for name, (i, o) in prices.items():
        out = F.when(model == name, (tokens_in * i + tokens_out * o) / 1e6).otherwise(out)
    return out


def sweep(scored: DataFrame, shares: DataFrame, k: int = 8) -> DataFrame:
    """Top k of each profile and question: cosine and rrf of a pair are computed once and joined to all profiles (name, rrf_share)."""
    from palimpsest.operators.retrieval import ORDER, ranked

    j = scored.crossJoin(F.broadcast(shares))  # a fixed, small table of profiles
    j = j.withColumn("score", F.col("rrf_share") * F.col("nrrf") + (1 - F.col("rrf_share")) * F.col("cos"))
    r = ranked(j, [F.desc(F.round("score", ORDER)), F.asc("chunk_id")], ["name", "qid"], "rank")
    return r.where(F.col("rank") <= k).select("name", "qid", "chunk_id", "rank")


#: What a judge may say, and the word for a response that says none of them.
VERDICTS, UNPARSED = ("correct", "partial", "incorrect"), "unparsed"


def judge_verdict(raw: Column) -> Column:
    """(verdict, reason) of a judge's response: JSON, in a fence or not, with one of the three verdicts, and a reason of at most 200
    characters, empty if it is no string. Anything else, a null response too, is ``unparsed``, with its first 150 characters."""
    raw = F.coalesce(raw, F.lit(""))
    bare = F.regexp_replace(raw, "^\\s+|\\s+$", "")
    body = F.try_parse_json(F.regexp_replace(F.regexp_replace(bare, "(?i)^```(json)?\\s*", ""), "\\n?```$", ""))
    said = lambda k: F.when(F.schema_of_variant(F.try_variant_get(body, f"$.{k}", "variant")) == "STRING", F.try_variant_get(body, f"$.{k}", "string"))
    good = F.coalesce(said("verdict").isin(*VERDICTS), F.lit(False))
    lost = F.concat(F.lit("judge did not return valid JSON: "), F.substring(raw, 1, 150))
    return F.struct(F.when(good, said("verdict")).otherwise(UNPARSED).alias("verdict"), F.when(good, F.coalesce(F.substring(said("reason"), 1, 200), F.lit(""))).otherwise(lost).alias("reason"))


def graded(answerable: Column, abstention: Column, judged: Column) -> Column:
    """The verdict of an answer: the judge's where there is a gold answer; else abstaining is correct, answering incorrect, hedging partial."""
    alone = F.when(abstention == "abstained", "correct").when(abstention == "answered", "incorrect").otherwise("partial")
    return F.when(answerable, judged).otherwise(alone)
