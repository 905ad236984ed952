"""Exclusive claims with a lease, kept as numbered files in a shared folder.

The claim with the highest number holds. To claim, renew or release is to create the
next number exclusively, which fails if someone else did so first.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from coldhaul.sinks import folders

LEASE_SECONDS = 6 * 3600


class Claimed(RuntimeError):
    """Someone else holds the claim, or has taken it over."""


@dataclass
class Claim:
    """A held claim. Leaving its ``with`` block releases it."""

    spark: SparkSession
    folder: str
    owner: str
    seconds: float
    clock: Callable[[], float]
    token: str = field(default_factory=lambda: uuid.uuid4().hex)
    number: int = 0

    def _write(self, number: int, until: float) -> bool:
        text = json.dumps({"owner": self.owner, "token": self.token, "until": until})
        return folders.create_new(self.spark, f"{self.folder}/{number:012d}", text)

    def check(self) -> None:
        """Raise unless the claim is still this one; to be called ahead of each commit."""
        number, held = _latest(self.spark, self.folder)
        if held.get("token") != self.token:
            raise Claimed(f"{self.folder} was taken over by {held.get('owner', 'someone')}")
        self.number = number

    def renew(self) -> None:
        """Lengthen the lease by its time from now."""
        self.check()
        if not self._write(self.number + 1, self.clock() + self.seconds):
            raise Claimed(f"{self.folder} was taken over")
        folders.remove(self.spark, f"{self.folder}/{self.number:012d}")
        self.number += 1

    def release(self) -> None:
        number, held = _latest(self.spark, self.folder)
        if held.get("token") == self.token and self._write(number + 1, 0):
            folders.remove(self.spark, f"{self.folder}/{number:012d}")

    def __enter__(self) -> Claim:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def _latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the claim that holds; a file without content yet holds without end."""
    numbers = [n for n in folders.names(spark, folder) if n.isdigit()]
    if not numbers:
        return 0, {"until": 0}
    try:
        return int(numbers[-1]), json.loads(folders.read_text(spark, f"{folder}/{numbers[-1]}"))
    except ValueError:
        return int(numbers[-1]), {"until": float("inf"), "owner": "someone who is just claiming"}


def claim(
    spark: SparkSession,
    folder: str,
    owner: str,
    seconds: float = LEASE_SECONDS,
    clock: Callable[[], float] = time.time,
) -> Claim:
    """Claim a folder for a lease of ``seconds``; raises Claimed while another claim holds.

    A claim that ran out, as its holder died, is taken over. A holder that lives on must
    renew in time; its next check fails otherwise. Clocks of drivers may differ by less
    than a lease.
    """
    number, held = _latest(spark, folder)
    if held["until"] > clock():
        raise Claimed(f"{folder} is held by {held.get('owner')}")
    mine = Claim(spark, folder, owner, seconds, clock)
    if not mine._write(number + 1, clock() + seconds):
        raise Claimed(f"{folder} was claimed by another at the same time")
    mine.number = number + 1
    for n in folders.names(spark, folder):
        if n.isdigit() and int(n) < mine.number:
            folders.remove(spark, f"{folder}/{n}")
    return mine
