"""Training sets: sampling, weighting, splits and formats, all by hashes so that a second run gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, question_for, strip, truncate_answer, unfenced

LEAST, MOST, LEAST_WORDS, VALIDATION, SEED = 50, 3200, 8, 0.1, 42


def draw(key: Column, seed: int = SEED) -> Column:
    """A place in a seeded random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def stratified(rows: DataFrame, by: str, key: str, n: int, seed: int = SEED) -> DataFrame:
    w = Window.partitionBy(by).orderBy(draw(F.col(key), seed), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


#: Ranges that keys are counted in; their counts are broadcast.
RANGES = 4096


def systematic(rows: DataFrame, key: str, step: int, n: int) -> DataFrame:
    """Every step-th row in the order of key, the first n of them; rows are numbered by counts below each, not in one task.

    key must be distinct numbers. They are counted in at most RANGES ranges of equal width, the counts summed, and rows numbered in their range.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return rows.limit(0)
    block = F.floor((F.col(key) - low) / max(1, -(-(int(high) - int(low) + 1) // RANGES)))
    sizes = rows.groupBy(block.alias("_b")).agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    numbered = rows.withColumn("_b", block).withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1)
    at = numbered.join(F.broadcast(before), "_b").withColumn("_n", F.col("_before") + F.col("_i"))
    return at.where((F.col("_n") % step == 0) & (F.col("_n") < step * n)).drop("_b", "_i", "_n", "_before")


def replicate(rows: DataFrame, weight: Column) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), weight)))


def split(rows: DataFrame, key: Column, share: float = VALIDATION) -> DataFrame:
    """part: train, or validation for the last share (at least one row) of a seeded shuffle."""
    h = rows.withColumn("_h", draw(key))
    total = h.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("_val"))
    # ranks by leading digits of the hash: counts of 4,096 groups give each group's start
    lead = F.substring("_h", 1, 3)
    sizes = h.groupBy(lead.alias("_g")).agg(F.count("*").alias("_c"))
    after = sizes.withColumn("_after", F.coalesce(F.sum("_c").over(Window.orderBy(F.col("_g").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    placed = h.withColumn("_g", lead).withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy(F.col("_h").desc()))).join(F.broadcast(after), "_g")
    out = placed.crossJoin(F.broadcast(total)).withColumn("part", F.when(F.col("_after") + F.col("_i") <= F.col("_val"), "validation").otherwise("train"))
    return out.select(*rows.columns, "part")


def chunk_questions(chunks: DataFrame) -> DataFrame:
    """question, answer of chunks of fit length. chunks: content_type, source_name, title, content."""
    c = F.col("content")
    fit = F.length(c).between(LEAST, MOST) & (F.size(F.filter(F.split(c, r"[ \t\n\r\f\x0B]+"), lambda x: x != "")) >= LEAST_WORDS)
    return chunks.where(fit).withColumn("question", question_for(F.col("content_type"), F.col("source_name"), F.col("title"), c)).withColumn("answer", truncate_answer(c))


def longest_answers(rows: DataFrame, order: str) -> DataFrame:
    """For each question, whatever its case and spacing, the longest answer; of equals the first."""
    key = collapse(F.lower("question"))
    best = rows.groupBy(key.alias("_q")).agg(F.max(F.struct(F.length("answer"), -F.col(order))).alias("_best"))
    return rows.withColumn("_q", key).join(best, "_q").where((F.length("answer") == F.col("_best.col1")) & (-F.col(order) == F.col("_best.col2"))).select(*rows.columns)


def dialogue_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant's next one. turns: conv_id, turn, role, text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return after.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def eval_questions(posts: DataFrame, golden: DataFrame) -> DataFrame:
    """id, source, question, context, expected_answer, key_facts of both test sets; what a row lacks is blank. Ids of posts get a prefix."""
    facts = F.coalesce("key_facts", F.expr("CAST(array() AS array<string>)")).alias("key_facts")
    part = lambda rows, key, source, context: rows.select(key.alias("id"), F.lit(source).alias("source"), "question", context.alias("context"), _blank(F.col("expected_answer")).alias("expected_answer"), facts)
    return part(posts, F.concat(F.lit("reddit_"), F.col("id").cast("string")), "reddit", _blank(F.col("context"))).unionByName(part(golden, F.col("id").cast("string"), "golden", F.lit("")))


def retrieval_pairs(golden: DataFrame, posts: DataFrame, saved: DataFrame | None = None, made: Callable[[], DataFrame] | None = None) -> DataFrame:
    """question, ground_truth_chunk_ids, source_title of all questions with source chunks; where there is none the saved pairs, else those that ``made`` makes."""
    part = lambda rows: rows.where(F.size("source_chunks") > 0).select("question", F.transform("source_chunks", lambda c: c["chunk_id"]).alias("ground_truth_chunk_ids"), F.get("source_chunks", F.lit(0))["title"].alias("source_title"))
    found = part(golden).unionByName(part(posts))
    if not found.isEmpty():
        return found
    if saved is not None and not saved.isEmpty():
        return saved
    return made() if made else found


def _pairs(rows: DataFrame, answer: Column, source: str, *more: str) -> DataFrame:
    named = rows.select(strip(_blank(F.col("question"))).alias("question"), strip(_blank(answer)).alias("answer"), *more, F.lit(source).alias("source"))
    return named.where("question <> '' AND answer <> ''")


def golden_pairs(golden: DataFrame) -> DataFrame:
    """question, answer, source: the expected answer, or the key facts joined where that is blank; rows without either go."""
    given = strip(_blank(F.col("expected_answer")))
    return _pairs(golden, F.when(given != "", given).otherwise(F.array_join("key_facts", " ")), "golden")


# The fields that can hold a post's answer, in the order in which they are asked.
POST_ANSWERS = ["expected_answer", "enriched_answer", "ideal_answer", "answer"]


def post_pairs(posts: DataFrame) -> DataFrame:
    """question, answer, source: the first answer field that is not empty; a post's context is not put before its question."""
    return _pairs(posts, F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in POST_ANSWERS]), "reddit")


def grounded_pairs(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """question, answer, context, source: golden rows with the texts of their source chunks, numbered as the row names them; rows of which no chunk is known go.

    golden: id, question, expected_answer, source_chunks; chunks: chunk_id, title, source_url, content.
    """
    named = golden.select("id", F.posexplode("source_chunks").alias("pos", "s")).select("id", "pos", F.col("s.chunk_id").alias("chunk_id"))
    known = named.join(chunks.select("chunk_id", "title", "source_url", "content"), "chunk_id")
    part = F.concat(F.lit("[Source "), (F.col("pos") + 1).cast("string"), F.lit(": "), "title", F.lit(" ("), "source_url", F.lit(")]\n"), "content")
    context = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))).alias("ps"))  # a row names few chunks
    context = context.select("id", F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n---\n\n").alias("context"))
    return _pairs(golden.join(context, "id"), F.col("expected_answer"), "rag", "context").select("question", "answer", "context", "source")


def chunk_pairs(chunks: DataFrame, order: str) -> DataFrame:
    """question, answer, source of chunks of fit length, one for each question: that of the longest answer."""
    return longest_answers(chunk_questions(chunks), order).select("question", "answer", F.lit("chunk").alias("source"))


def topic_quotas(rows: DataFrame, by: str, key: str, quotas: dict[str, int], default: int = 0, seed: int = SEED) -> DataFrame:
    """As many rows of each topic as its quota says, in a seeded random order. Each task sends on as many rows of a topic as the greatest quota, however many a topic has."""
    most = max([default, *quotas.values()])
    quota = F.coalesce(F.element_at(F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))]), F.col(by)), F.lit(default)) if quotas else F.lit(default)
    w = Window.partitionBy(by).orderBy(draw(F.col(key), seed), key)
    return rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= most) & (F.col("_n") <= quota)).drop("_n")


def fixed_set(rows: DataFrame, key: str, tiers: DataFrame) -> DataFrame:
    """Rows whose key is in tiers (key, tier), with the tier."""
    return rows.join(tiers.select(key, "tier").distinct(), key)


def golden_set(chunks: DataFrame, topic: Column, quotas: dict[str, int], generate: Callable[[Column], Column], key: str = "chunk_id", default: int = 0) -> DataFrame:
    """id, topic, question, expected_answer, key_facts, source_chunks: questions that a model makes of chunks chosen by topic.

    chunks: chunk_id, title, source_url, content. ``generate`` returns JSON with question, answer and key_facts, fenced or not; chunks
    whose JSON cannot be read or has no question go. Ids are the chunks' own, so that a second run gives the same.
    """
    chosen = topic_quotas(chunks.withColumn("topic", topic), "topic", key, quotas, default)
    made = chosen.withColumn("_q", F.from_json(unfenced(generate(F.col("content"))), "question string, answer string, key_facts array<string>")).where("_q.question <> ''")
    source = F.array(F.struct(F.col(key).cast("string").alias("chunk_id"), "title", "source_url"))
    none = F.expr("CAST(array() AS array<string>)")
    return made.select(F.concat(F.lit("golden_"), F.col(key).cast("string")).alias("id"), "topic", F.col("_q.question").alias("question"), F.coalesce("_q.answer", F.lit("")).alias("expected_answer"), F.coalesce("_q.key_facts", none).alias("key_facts"), source.alias("source_chunks"))
