"""Coded errors. ``code`` is stable; messages may change."""

from __future__ import annotations


class DensparkError(Exception):
    """Base of all errors raised here."""

    code = "ERROR"

    def __init__(self, message: str = "", **details):
        super().__init__(message or self.code)
        self.details = details


def _family(base: str, prefix: str, names: str) -> dict[str, type]:
    made = {base: type(base, (DensparkError,), {"__doc__": f"{base} family."})}
    for name in names.split():
        made[name] = type("".join(w.title() for w in name.split("_")) + base, (made[base],), {"code": prefix + name})
    return made


# The stable codes of each family.
DATA_SOURCE = _family("DataSourceError", "DATA_SOURCE_", "OUT_OF_BOUNDS OUTPUT_LENGTH_MISMATCH DIMENSION_MISMATCH EMPTY ZERO_DIMENSION")
ENGINE = _family("EngineError", "", "INVALID_MIN_CLUSTER_SIZE EMPTY_SOURCE INSUFFICIENT_ITEMS BACKEND_UNAVAILABLE DATA_SOURCE_FAILURE CPU_HNSW_FAILURE CPU_MST_FAILURE CPU_HIERARCHY_FAILURE MEMORY_LIMIT_EXCEEDED SESSION_CONFLICT")
INDEX = _family("IndexingError", "", "EMPTY_BUILD INVALID_PARAMETERS DUPLICATE_NODE GRAPH_EMPTY GRAPH_INVARIANT_VIOLATION NON_FINITE_DISTANCE")
FOREST = _family("ForestError", "", "EMPTY_GRAPH INVALID_NODE_ID NON_FINITE_WEIGHT INVARIANT_VIOLATION")
HIERARCHY = _family("HierarchyError", "", "EMPTY_DATASET MIN_CLUSTER_SIZE_TOO_LARGE INVALID_EDGE_WEIGHT")
DISTANCE = _family("DistanceError", "", "ZERO_LENGTH DIMENSION_MISMATCH NON_FINITE ZERO_MAGNITUDE INVALID_NORM")
LABELS = _family("LabelError", "", "MISSING_ZERO GAP DUPLICATE OVERFLOW LENGTH_MISMATCH")
INGEST = _family("IngestError", "", "COLUMN_NOT_FOUND INVALID_COLUMN_TYPE INVALID_LIST_VALUE_TYPE INVALID_DIMENSION NULL_ROW NULL_VALUE INVALID_ROW_LENGTH EMPTY_INPUT")
RECIPE = _family("RecipeError", "", "FETCH VALIDATE PREPARE PUBLISH CLEANUP CHECKSUM_UNSUPPORTED INVALID_NAME")
