"""quillspan: a PySpark-native engine for comparing independent transcriptions of the same pages.

The names below are loaded when first used, so that workers import only what they run.
"""

from importlib import import_module

EXPORTS = {
    "pair_scores": "operators.consensus", "consensus": "operators.consensus", "tolerant_rank": "operators.consensus", "pair_summary": "operators.consensus",
    "panel_scores": "operators.panel", "leave_one_family_out": "operators.panel", "family_sensitivity": "operators.panel",
    "corroborate": "operators.corroboration", "sequence_similarity": "operators.alignment", "repair_hyphens": "operators.alignment",
    "region_agreement": "operators.regions", "localization": "operators.regions", "read_pages": "operators.extraction", "value_agreement": "operators.extraction", "profile_predictions": "operators.extraction",
    "counters": "operators.benchmark", "ratios": "operators.benchmark", "method_scores": "operators.benchmark", "violations": "operators.benchmark", "variant_differences": "operators.benchmark",
    "shortlist": "operators.discovery", "discover": "operators.discovery", "catalog_from_graph": "operators.discovery",
    "bootstrap": "operators.statistics", "compiled": "operators.vocabulary", "read_bundle": "sources.json_io", "read_corpus": "sources.json_io",
}
__all__ = sorted(EXPORTS)


def __getattr__(name: str):
    if name not in EXPORTS:
        raise AttributeError(name)
    return getattr(import_module(f".{EXPORTS[name]}", __name__), name)
