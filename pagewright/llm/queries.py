"""The queries of this subpackage, and their SQL where SQL can express them."""

from . import bpe, decontam, langid, lm, quality, simhash, sstable, token_count, urlfilter, warc

QUERIES = {
    "op1_warc_roundtrip": warc.op1_warc_roundtrip,
    "op2_host_quality": quality.op2_host_quality,
    "op3_token_sstable": sstable.op3_token_sstable,
    "op4_lattice_score": lm.op4_lattice_score,
    "op5_token_counts": token_count.op5_token_counts,
    "op6_language_id": langid.op6_language_id,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_url_rules": urlfilter.op9_url_rules,
    "op10_simhash_golay": simhash.op10_simhash_golay,
}
ORACLES = {"op1_warc_roundtrip": warc.ORACLE_SQL, "op2_host_quality": quality.ORACLE_SQL, "op8_decontamination": decontam.ORACLE_SQL}
