"""The registered queries: each applies its operator to its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import (
    chat,
    kneser_ney,
    mixing,
    phrases,
    quality,
    repetition,
    simhash,
    sql,
    suffixes,
    trie,
    urls,
    vector_codes,
    vector_dedup,
    winnow,
)
from creditloom.llm.registry import ORACLES, QUERIES, query, table
from creditloom.operators.joins import lookup_join
from creditloom.staging import stage

__all__ = ["ORACLES", "QUERIES"]


@query()
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=3, max_bits=2)
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        digits.alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


WORDS = r"[^\x20\x09-\x0D]+"


def _kept_words(text: str):
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


@query(sql.OP9)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = phrases.remove_repeats(docs, width=20)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_removed",
        F.sha2(F.array_join(_kept_words("kept_text"), " "), 256).alias("kept_sha256"),
    )


@query(sql.OP6)
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = winnow.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), width=13)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        winnow.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query(sql.OP8)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = repetition.judge_texts(docs, keep_text=False)
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), *repetition.STATS[:5], "base_failed", "kept"
    )


@query(sql.OP10)
def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs)
    first = F.round(F.get("positions", F.lit(0)), 6)
    return mixed.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        "taken",
        "copies",
        first.alias("first_position"),
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


@query()
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    model = kneser_ney.train(docs.where(~F.col("held_out")))
    return kneser_ney.score(docs, model).select(
        "row.doc_id",
        "row.held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    return scored.select("row.doc_id", "score").select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query()
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.repeated_passages(docs, length=50).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_repeated",
        (F.col("n_repeated") > 0).alias("repeats"),
        "spans",
        F.col("others").alias("other_doc_ids"),
    )


URL_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


@query(sql.OP5)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.withColumnRenamed("id", "page_id")


#: A conversation whose texts hold control strings of several templates.
TRAP_ID, TRAP = -7, r"\### Assistant: </turn> ok"


@query(sql.OP7)
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(TRAP_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRAP).alias("text"),
    )
    rows = turns.unionByName(trap).withColumn(
        "parts", chat.whole_parts(chat.text_parts(F.col("text")))
    )
    done = chat.format_chats(rows)
    read = done.withColumns(
        {
            "turns": chat.read_turns(F.col("formatted")),
            "trained": chat.trained_text(F.col("formatted"), F.col("loss")),
        }
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(sql.OP13)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    found = vector_codes.compress(vectors, parts=8, entries=16, rounds=6, scale=4096)
    # Rows without a label are a group like any other.
    group = F.coalesce(F.concat(F.lit("="), F.col("row.label").cast("string")), F.lit("none"))
    coded = found.rows.select(
        F.col("row.vec_id").alias("vec_id"),
        F.lower(F.hex("code")).alias("code"),
        "error",
        group.alias("label_group"),
    )
    totals = coded.groupBy("label_group").agg(F.sum("error").alias("label_error"))
    return lookup_join(coded, totals, ["label_group"]).select(
        "vec_id",
        "code",
        "error",
        "label_error",
        F.lit(found.digest()).alias("codebooks_sha256"),
    )


#: Turns that a conversation borrows at most, less one.
BORROWED = 6


def _rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations that begin with the first h turns of conversation id - id % 100."""
    donor = F.col("id") - F.col("id") % 100
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % BORROWED).cast("int")
    heads = convs.where(F.col("id") % 100 == 0).select(
        F.col("id").alias("donor"), F.slice("turns", 1, BORROWED - 1).alias("head")
    )
    own = convs.withColumns({"donor": donor, "h": h})
    own = own.withColumn("rest", F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return own.join(heads, "donor", "left").select("id", F.concat(head, "rest").alias("turns"))


@query(sql.OP12)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = trie.gather_turns(table(spark, sf_dir, "conversations"))
    nodes = trie.prefix_trie(_rebuilt(stage(convs, "conversations")))
    return nodes.select(
        F.col("first").alias("conv_id"),
        "depth",
        F.col("parent_first").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )


@query(sql.OP11)
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return vector_dedup.near_duplicates(vectors, threshold=0.93).select(
        F.col("row.vec_id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        "kept",
    )
