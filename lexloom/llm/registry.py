"""Queries of this subpackage, one per operator, and their SQL."""

from . import ann, bpe, centroids, htmltext, langid, mixing, ngramjoin, phrases, quality, secrets, urlfilter, warc, whitening

QUERIES = {
    "op1_url_filters": urlfilter.query,
    "op2_ngram_join": ngramjoin.query,
    "op3_warc": warc.query,
    "op4_nearest_neighbours": ann.query,
    "op5_language_id": langid.query,
    "op6_mixing": mixing.query,
    "op7_byte_bpe": bpe.query,
    "op8_secret_scans": secrets.query,
    "op9_html_extraction": htmltext.query,
    "op10_quality_rules": quality.query,
    "op11_whitening": whitening.query,
    "op12_benchmark_decontamination": phrases.query,
    "op13_centroid_clustering": centroids.query,
}
ORACLES = {
    "op1_url_filters": urlfilter.oracle(),
    "op3_warc": warc.oracle(),
    "op6_mixing": mixing.oracle(),
    "op10_quality_rules": quality.oracle(),
    "op12_benchmark_decontamination": phrases.oracle(),
    "op13_centroid_clustering": centroids.oracle(),
}
