"""The queries of this subpackage and, where SQL can express them, their SQL."""

from vistaquad.llm.bpe import bpe_query
from vistaquad.llm.codes import COMPRESSION_SQL, compression_query
from vistaquad.llm.common import table
from vistaquad.llm.decontaminate import CONTAMINATION_SQL, contamination_query
from vistaquad.llm.exact import EXACT_SQL, exact_query
from vistaquad.llm.importance import RESAMPLING_SQL, resampling_query
from vistaquad.llm.licenses import licence_query
from vistaquad.llm.minhash import near_duplicate_query
from vistaquad.llm.neighbours import neighbour_query
from vistaquad.llm.quality import quality_query
from vistaquad.llm.secrets import secret_query
from vistaquad.llm.suffix import passage_query
from vistaquad.llm.toxicity import toxicity_query
from vistaquad.llm.warc import WARC_SQL, warc_query


def _documents(query):
    return lambda spark, sf_dir: query(table(spark, sf_dir, "documents"))


def _labelled(query):
    return lambda spark, sf_dir: query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_minhash_near_dedup": _documents(near_duplicate_query),
    "op2_repeated_passages": _documents(passage_query),
    "op3_byte_bpe": _documents(bpe_query),
    "op4_exact_dedup": _documents(exact_query),
    "op5_quality": _labelled(quality_query),
    "op6_warc": lambda spark, sf_dir: warc_query(table(spark, sf_dir, "pages")),
    "op7_toxicity": _labelled(toxicity_query),
    "op8_decontamination": lambda spark, sf_dir: contamination_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op9_licenses": _documents(licence_query),
    "op10_secrets": _documents(secret_query),
    "op11_vector_codes": lambda spark, sf_dir: compression_query(table(spark, sf_dir, "embeddings")),
    "op12_nearest_neighbours": lambda spark, sf_dir: neighbour_query(table(spark, sf_dir, "embeddings")),
    "op13_importance_resampling": lambda spark, sf_dir: resampling_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}

ORACLES = {
    "op4_exact_dedup": EXACT_SQL,
    "op6_warc": WARC_SQL,
    "op8_decontamination": CONTAMINATION_SQL,
    "op11_vector_codes": COMPRESSION_SQL,
    "op13_importance_resampling": RESAMPLING_SQL,
}
