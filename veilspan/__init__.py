"""Span analytics over documents, on Spark. The names below are loaded when they are first asked for."""

from importlib import import_module

#: Public names and where they live.
_HOMES = {
    "session": "session", "ship": "session",
    "redact": "plans.redact", "redact_files": "plans.redact", "redact_long": "plans.redact", "analyse": "plans.redact", "analyse_readings": "plans.redact", "apply": "plans.redact", "Analysis": "plans.redact",
    "PATTERNS": "functions.patterns", "LABELS": "functions.dimensions",
    "find_patterns": "operators.extract", "with_patterns": "operators.extract", "dictionary": "operators.extract", "pattern_spans": "operators.extract", "spans_by": "operators.extract",
    "mask_texts": "operators.mask", "merge_ranges": "operators.spans", "absorb_nested": "operators.spans", "verified": "operators.verify", "leaks": "operators.verify",
    "languages": "operators.language", "counts": "operators.evaluate", "by_label": "operators.evaluate", "by_language": "operators.evaluate",
    "MODELS": "operators.codec", "Codec": "operators.codec", "detector": "operators.codec",
    "read_texts": "sources.formats", "write_zip": "sources.archive", "redact_rows": "streaming.redact", "redact_batches": "streaming.redact",
}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(name)
    home = import_module(f"veilspan.{_HOMES[name]}")
    return home if name == _HOMES[name] else getattr(home, name)
