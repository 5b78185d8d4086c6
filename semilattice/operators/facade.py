"""A collection's own operations on a device: what callers may set, default transactions, ranks."""

from __future__ import annotations

from semilattice.functions.merge import rank_between
from semilattice.functions.wire import present
from semilattice.operators.device import Device
from semilattice.plans.schema import BASE_FIELDS, SchemaError


class CollectionFacade:
    """create, update, delete and restore of one collection; an event log has ``create`` alone.

    Values left out (``...``) are not written, None is. Base fields are the framework's and immutable ones are set
    when a row is made and never again. Each call is a transaction of its own unless it is given one.
    """

    def __init__(self, device: Device, table: str) -> None:
        self.device, self.table, self.declared = device, table, device.schema[table]

    def _values(self, values: dict, making: bool) -> dict:
        values = present(values)
        for name in values:
            if name in BASE_FIELDS:
                raise SchemaError(f"{self.table}.{name} is set by the framework")
            if not making and self.declared.field(name).merge == "immutable":
                raise SchemaError(f"{self.table}.{name} is immutable")
        return values

    def _mutable(self) -> None:
        if self.declared.kind == "eventLog":
            raise SchemaError(f"{self.table} only grows")

    def create(self, row_id: str, values: dict, txn: str | None = None) -> None:
        self.device.create(self.table, row_id, self._values(values, True), txn)

    def update(self, row_id: str, values: dict, txn: str | None = None) -> None:
        self._mutable()
        self.device.update(self.table, row_id, self._values(values, False), txn)

    def delete(self, row_id: str, txn: str | None = None) -> None:
        self._mutable()
        self.device.delete(self.table, row_id, txn)

    def restore(self, row_id: str, values: dict, txn: str | None = None) -> None:
        self._mutable()
        self.device.restore(self.table, row_id, self._values(values, True), txn)

    def rows(self) -> dict[str, dict]:
        """The collection's live rows by id."""
        return {r: dict(row.fields) for (t, r), row in self.device.rows.items() if t == self.table}

    def next_rank(self, field: str) -> str:
        """A rank behind all rows."""
        ranks = [str(v[field]) for v in self.rows().values() if v.get(field) is not None]
        return rank_between(max(ranks, default=None), None, self.device.device_id)

    def move(self, row_id: str, field: str, by: int) -> bool:
        """Moves a row one place up (-1) or down (1) in the order of its ranks; False at the end of the list."""
        order = sorted((str(v[field]), r) for r, v in self.rows().items() if v.get(field) is not None)
        at = next((i for i, (_, r) in enumerate(order) if r == row_id), None)
        if at is None or not 0 <= at + by < len(order) or by not in (-1, 1):
            return False
        rank = lambda i: order[i][0] if 0 <= i < len(order) else None
        low, high = (rank(at - 2), rank(at - 1)) if by < 0 else (rank(at + 1), rank(at + 2))
        self.update(row_id, {field: rank_between(low, high, self.device.device_id)})
        return True
