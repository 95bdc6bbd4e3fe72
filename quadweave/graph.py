"""A graph table with the operators as methods."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadweave.functions import counts, grid
from quadweave.operators import diff, filters, mutate, references, tableview

_FUNCTIONS = {
    name: getattr(module, name)
    for module, names in (
        (filters, "filter_facts filter_by_type filter_by_facts filter_by_value object_data namespace_map in_scope"),
        (tableview, "type_tableview key_tableview id_tableview tableviews"),
        (references, "references_all references_to references_from references references_to_simple references_from_simple references_simple dangling_references"),
        (mutate, "set_value_at_key set_value_at_key_and_id update_from_facts update_from_view remove_facts"),
        (diff, "diff diff_by_instance diff_text content_hash"),
        (counts, "types_count type_shares"),
        (grid, "limits switch_terminals scale_load loaded_models model_facts model_parts eic_map header_from_filenames filenames_from_header header_of update_header"),
    )
    for name in names.split()
}


class Graph:
    """Methods take and give DataFrames; those that give a graph table can be wrapped again."""

    def __init__(self, data: DataFrame):
        self.data = data

    def __getattr__(self, name: str):
        if name not in _FUNCTIONS:
            raise AttributeError(name)
        return lambda *a, **k: _FUNCTIONS[name](self.data, *a, **k)

    def __dir__(self):
        return [*super().__dir__(), *_FUNCTIONS]

    def cached(self):
        """A context in which the table is kept in memory."""
        return _Cached(self)


class _Cached:
    def __init__(self, graph: Graph):
        self.graph = graph

    def __enter__(self) -> Graph:
        self.graph.data = self.graph.data.cache()
        return self.graph

    def __exit__(self, *_) -> None:
        self.graph.data.unpersist()
