"""The relations of a code graph as explicit schemas, and the orders of their enumerations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES = "path string, language string"
SYMBOLS = "symbol_index bigint, id string, file_path string, kind string, name string, qualified_name string, parent_symbol_id string, owner_type_name string, return_type_name string, visibility string, parameter_count int, required_parameter_count int, start_line int, end_line int"
REFS = "ref_index bigint, file_path string, enclosing_symbol_id string, kind string, target_name string, binding_name string, line int, arity int, receiver_name string, receiver_type_name string, call_form string, class_literal_argument string, class_literal_arguments array<string>"
EDGES = "edge_index bigint, source_file_path string, source_symbol_id string, target_file_path string, target_symbol_id string, reference_target_name string, kind string, relation_kind string, layer string, strength string, origin string, resolution_tier string, confidence_millis int, reason string, line int, occurrence_index int"
SOURCES = "file_path string, text string"
SCAN = "relative_path string, size_bytes bigint, modified_at timestamp, content_hash bigint"
OUTCOMES = "file_path string, parser string, scope string, required_recovery boolean, diagnostic_count int, diagnostics array<struct<kind:string,node_kind:string,start_line:int,end_line:int>>, diagnostics_truncated boolean"

#: Members of the enumerations in their declared order.
LANGUAGES = ["JavaScript", "Php", "Python", "Ruby", "Rust", "TypeScript"]
SYMBOL_KINDS = ["Class", "Function", "Interface", "Method", "Struct", "Enum", "Trait", "Module"]
REFERENCE_KINDS = ["Import", "TypeImport", "Call", "Type", "Extends", "Implements", "Overrides"]
LAYERS = ["Structural", "Runtime", "Framework", "PolicyOverlay"]
STRENGTHS = ["Synthetic", "Dynamic", "Inferred", "Hard"]  # weakest first
TIERS = ["Global", "ImportScoped", "SameFile"]  # least sure first
TIER_CONFIDENCE = {"SameFile": 950, "ImportScoped": 900, "Global": 500}
RELATIONS = ["Import", "Call", "Dispatch", "ContainerResolution", "EventSubscribe", "EventPublish", "TypeUse", "Extends", "Implements", "Overrides"]
DEPENDENCY_KINDS = ["Import", "TypeImport", "Call", "Type", "Extends", "Implements"]


def rank(column: str | Column, order: list[str]) -> Column:
    """Place in an enumeration, null for others."""
    return F.create_map(*[v for i, x in enumerate(order) for v in (F.lit(x), F.lit(i))])[F.col(column) if isinstance(column, str) else column]


def named(place: Column, order: list[str]) -> Column:
    """The member at a place."""
    return F.element_at(F.array(*map(F.lit, order)), place + 1)


@dataclass
class Graph:
    """Named frames of one analysed repository."""

    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    edges: DataFrame
    sources: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)
