"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .op1_secrets import op1_secret_scan
from .op2_pii import op2_pii_sanitisation
from .op3_fingerprint import op3_lz_fingerprint
from .op4_packing import op4_vector_packing
from .op5_lines import op5_line_dedup
from .op6_licenses import op6_license_scan
from .op7_mixing import op7_source_mixing
from .op8_quality import op8_risk_controlled_quality
from .op9_simhash import op9_simhash_near_dedup
from .op10_importance import op10_importance_resampling
from .op11_merkle import op11_merkle_manifest
from .op12_decontaminate import op12_benchmark_decontamination
from .op13_audit import op13_filter_audit
from .oracle import ORACLE_SQL  # noqa: F401


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_pii_sanitisation,
        op3_lz_fingerprint,
        op4_vector_packing,
        op5_line_dedup,
        op6_license_scan,
        op7_source_mixing,
        op8_risk_controlled_quality,
        op9_simhash_near_dedup,
        op10_importance_resampling,
        op11_merkle_manifest,
        op12_benchmark_decontamination,
        op13_filter_audit,
        pipeline,
    )
}
