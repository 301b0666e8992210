"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashwave.llm import audit, bpe, chat, exact, html, jaccard, merkle, mixing, quality, token_counts, tokenfile, urls, vectors
from hashwave.llm.common import local_shared_dir, read_table, rows_per_batch, tokenizer_path, written
from hashwave.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under the name of its function."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        local_shared_dir(spark)
        return build(spark, str(sf_dir).rstrip("/"))

    _REGISTRY[build.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and give digests of both."""
    path = tokenizer_path()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.decode(bpe.encode(docs, path).drop("text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in, those labelled bad go, those labelled good are
    counted again by a newer tokenizer. Every batch is delivered twice and the table is compacted in between.
    """
    old, new = "byte_bpe_50k", "byte_bpe_multi_50k"
    files = {version: tokenizer_path(f"{version}.tiktoken") for version in (old, new)}
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    with rows_per_batch(spark, token_counts.BATCH):
        counts = written(token_counts.count_tokens(docs, files), "counts")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    labelled = lambda q: counts.join(labels.where(F.col("quality") == q).select("doc_id").distinct(), "doc_id", "left_semi")
    batches = {
        "1-insert": token_counts.inserts(counts, old, f"n_{old}"),
        "2-delete": token_counts.deletes(labelled(0), old, f"n_{old}"),
        "3-revise": token_counts.revisions(labelled(1), (old, f"n_{old}"), (new, f"n_{new}")),
    }
    rollup = token_counts.TokenRollup(spark, shared_dir(spark, "token-counts"))
    for batch, changes in batches.items():
        rollup.commit(changes, batch)
        rollup.commit(changes, batch)
        rollup.compact()
    return rollup.totals()


@query
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mixing.sized(docs, "doc_id")
    taken = mixing.times(rows).withColumnsRenamed({"key": "_of", "source": "_from"})
    rated = rows.join(taken, (rows["key"] == taken["_of"]) & rows["source"].eqNullSafe(taken["_from"]))
    return rated.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


#: A conversation whose texts hold the template's own control strings.
CONFLICT = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation, and read turns and loss texts back from the output."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = F.array(*(F.struct(*map(F.lit, row)) for row in CONFLICT))
    rows = F.inline(F.transform(added, lambda r: F.struct(*(r[f"col{i + 1}"].alias(n) for i, n in enumerate(turns.columns)))))
    chats = chat.format_chats(turns.unionByName(spark.range(1).select(rows)))
    turn_text = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    loss = F.array_join(chat.masked(F.col("formatted"), F.col("loss_spans")), "")
    back = chats.withColumn("_turns", chat.parsed(F.col("formatted"))).withColumn("_loss", loss)
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", turn_text), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token file of all documents, read it back, and give each document's place and checksum."""
    docs = read_table(spark, sf_dir, "documents")
    segments = tokenfile.read_segments(spark, tokenfile.token_file(docs, tokenizer_path()))
    return tokenfile.read_documents(segments).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "first_id", "last_id"
    )


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of the weighed rules."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    features = written(quality.with_features(docs).drop("text"), "features")
    model = quality.fit(features)
    return features.select(
        "doc_id",
        *quality.FEATURES,
        quality.base_failed().alias("base_failed"),
        quality.kept(model).alias("kept"),
        model.posterior().alias("quality"),
    )


@query
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by shingle similarity 0.8."""
    return jaccard.similar_texts(read_table(spark, sf_dir, "documents"))


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))


RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


@query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url by rule, or else by its aliases."""
    judged = urls.judge(read_table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of all documents, by language, in every order."""
    return audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and every document proved against it after some were tampered with."""
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    longer = F.col("n_chars").cast("decimal(19,0)") + 1
    leaves = merkle.document_leaves(docs, tampered, n_chars=longer)
    return merkle.manifest(leaves).proofs("changed").drop("lang")


@query
def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents, and which row of each stays."""
    found = exact.equal_texts(read_table(spark, sf_dir, "documents"), digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
