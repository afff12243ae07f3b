"""The queries of this folder and their SQL."""

from . import chat, fingerprints, line_dedup, ngram_join, packing, quality, sentencepiece_codec, sharding, topk, toxicity

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_quality": quality.op2_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sharding": sharding.op4_sharding,
    "op5_packing": packing.op5_packing,
    "op6_topk": topk.op6_topk,
    "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
    "op8_chat": chat.op8_chat,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLES: dict = {"op6_topk": topk.OP6_SQL}
