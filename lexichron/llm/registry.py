"""Queries of the training-data operators."""

from . import ann, bpe, crosstoken, license, media, mixing, neardup, packing, periodic, pii, quality, tokencount, toxicity

QUERIES = {
    "op1_license": license.op1_license,
    "op2_minhash": neardup.op2_minhash,
    "op3_ann": ann.op3_ann,
    "op4_tokens": tokencount.op4_tokens,
    "op5_media": media.op5_media,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe": bpe.op8_bpe,
    "op9_mixing": mixing.op9_mixing,
    "op10_pii": pii.op10_pii,
    "op11_packing": packing.op11_packing,
    "op12_periodic": periodic.op12_periodic,
    "op13_crosstoken": crosstoken.op13_crosstoken,
}
ORACLES: dict[str, str] = {"op1_license": license.OP1_SQL, "op2_minhash": neardup.OP2_SQL, "op3_ann": ann.OP3_SQL}
