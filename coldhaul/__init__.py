"""Archive operational tables and ingest JSON snapshots with Spark."""

from coldhaul.plans.archive import ArchiveFailed, ArchiveTable, JsonColumn, RunScope, archive
from coldhaul.plans.claims import Claimed
from coldhaul.plans.ledger import Ledger, archived
from coldhaul.plans.snapshot import ingest_snapshot
from coldhaul.session import configure

__all__ = [
    "ArchiveFailed",
    "ArchiveTable",
    "Claimed",
    "JsonColumn",
    "Ledger",
    "RunScope",
    "archive",
    "archived",
    "configure",
    "ingest_snapshot",
]
