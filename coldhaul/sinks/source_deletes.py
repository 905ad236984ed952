"""Deleting archived keys from the operational database."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


def delete_staged_keys(connection: Any, tables: Mapping[str, str], staging_table: str, staged_key: str) -> dict[str, int]:
    """Delete the staged keys from every table in one transaction.

    ``connection`` is a DB-API connection and ``tables`` maps a table to its
    key column. Nothing is deleted unless every statement succeeds. Returns the
    number of rows removed per table.
    """
    removed = {}
    cursor = connection.cursor()
    try:
        for table, key in tables.items():
            cursor.execute(f"DELETE FROM {table} WHERE {key} IN (SELECT {staged_key} FROM {staging_table})")
            removed[table] = cursor.rowcount
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        cursor.close()
    return removed
