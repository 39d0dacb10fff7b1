"""Corpus cleaning as a chain of stages; each is written as Parquet and read again by the next.

quality rules -> one document of each group of near duplicates -> removal of repeated passages ->
removal of contaminated documents -> token ids.

Defined results: a null or empty text fails the quality rules, so it reaches no later stage; a null id counts as
larger than any other; of repeated rows one stays; a text of any length is judged and encoded whole; a text of which all words are cut stays as an empty one; an
empty table passes all stages and gives no rows; extra columns pass through, whatever their names, up to the last stage.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, jaccard_join, relative_lz, repetition, winnowing
from tidemark.llm.bpe_files import default_path, default_pattern
from tidemark.llm.common import remove, scratch_under, shared_dir


def fresh(docs: DataFrame, name: str) -> str:
    """name, with underscores as long as docs has such a column."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the repetition rule rejects go."""
    name = fresh(docs, "repetition")
    return repetition.score(docs, into=name).filter(F.col(name)["kept"]).drop(name)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity one row stays: that of the smallest id, of rows with one id that of the least text.

    Texts without words are alone in their group, so of these one row an id stays.
    """
    return jaccard_join.one_a_component(docs)


def repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that a document with a smaller id has are cut from the text; n_chars follows."""
    name = fresh(docs, "relative_lz")
    cut = relative_lz.parse(docs, cut=True, into=name).drop(name)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark windows hit a twentieth or more go."""
    return winnowing.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and digests of them and of what they decode to."""
    return byte_bpe.encode_digests(docs, "doc_id", "text", default_path("byte_bpe_50k.tiktoken"), default_pattern(), ids=True)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", encoding),
]

#: SQL can express neither the components nor the encoding; tests/llm holds the chain against brute force.
ORACLE_SQL = None


def fingerprint(spark, *tables: DataFrame) -> str:
    """A digest of the files that tables read: their paths, lengths and times."""
    seen = []
    for table in tables:
        for uri in sorted(table.inputFiles()):
            at = spark._jvm.org.apache.hadoop.fs.Path(uri)
            status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
            seen.append(f"{uri} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join([*(name for name, _ in STAGES), *seen]).encode()).hexdigest()


def run(spark, sf_dir: str, name: str | None = None) -> DataFrame:
    """The stages one after the other on documents, each result written to the shared folder.

    A run of a name that was ended goes on after its last complete stage, given that its input files are the same; else ValueError.
    What a stage leaves for itself goes when it is complete, and its input with it, so that one result is kept at a time.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/tidemark/pipeline-{name or uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    mark = fingerprint(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if store.exists(path(f"{base}/input")):
        known = [x.getPath().getName() for x in store.listStatus(path(f"{base}/input"))]
        if known != [mark]:
            raise ValueError(f"run {name} began with other documents")
    store.mkdirs(path(f"{base}/input/{mark}"))
    done = [i for i in range(len(STAGES)) if store.exists(path(f"{base}/{i}/_SUCCESS"))]
    if done:
        docs = spark.read.parquet(f"{base}/{done[-1]}")
    for i, (_, stage) in enumerate(STAGES):
        if done and i <= done[-1]:
            continue
        with scratch_under(spark, f"{base}/scratch"):
            out = stage(spark, docs, sf_dir)
            out.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
    return docs
