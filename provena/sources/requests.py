"""Asking publication indexes: spacing, repeats and addresses. The transport is given by the caller.

``asked`` turns a table of addresses into a table of replies, in tasks that share the rate between them; ``Index`` asks one by one. Nothing in the engine asks by itself; replies
are stored and read as tables by ``provena.sources.replies``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame

# Addresses, requests a second without and with a key, and which answers are asked for again.
BASE = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"
STUDIES = "https://www.ebi.ac.uk/biostudies/api/v1/studies/"
PER_SECOND, PER_SECOND_WITH_KEY = 3, 10
ATTEMPTS, FIRST_WAIT = 4, 0.5


class Refused(Exception):
    """An answer with an HTTP status; ``fetch`` raises it."""

    def __init__(self, status: int):
        super().__init__(f"HTTP {status}")
        self.status = status


class Spacing:
    """Lets calls through at least ``1 / per_second`` seconds apart."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.last = 1 / per_second, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (rest := self.last + self.gap - self.clock()) > 0:
            self.sleep(rest)
        self.last = self.clock()


def patient(fetch: Callable[[str], bytes], address: str, spacing: Spacing, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """One answer; too many requests and server errors are asked for again, after ever longer waits."""
    for attempt in range(ATTEMPTS):
        spacing.wait()
        try:
            return fetch(address)
        except Refused as e:
            if attempt == ATTEMPTS - 1 or not (e.status == 429 or e.status >= 500):
                raise
            sleep(FIRST_WAIT * 2**attempt)
    raise AssertionError


def asked(wanted: DataFrame, fetch: Callable[[str], bytes], per_second: float = PER_SECOND, lanes: int = 1, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(address, status, body) of each different address in ``wanted``: what came back with status 200, or the status of a refusal that isn't asked for again.

    Addresses are dealt out to at most so many ``lanes``, each of which is one task at a time and keeps its share of the rate, so all together keep the rate however many run. Store the result at once: a
    lane that is lost asks again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spacing = Spacing(per_second / lanes, sleep=sleep)
        for frame in frames:
            found = []
            for address in frame["address"]:
                try:
                    found.append((address, 200, patient(fetch, address, spacing, sleep).decode()))
                except Refused as e:
                    found.append((address, e.status, None))
            yield pd.DataFrame(found, columns=["address", "status", "body"])

    return wanted.select("address").where("address is not null").distinct().repartition(lanes, "address").mapInPandas(run, "address string, status int, body string")


class Index:
    """Searches, summaries, links and citation matches; ``fetch`` takes an address and returns bytes."""

    def __init__(self, fetch: Callable[[str], bytes], key: str | None = None, email: str | None = None, spacing: Spacing | None = None, sleep: Callable[[float], None] = time.sleep):
        self.fetch, self.sleep = fetch, sleep
        self.more = {"tool": "provena"} | ({"api_key": key} if key else {}) | ({"email": email} if email else {})
        self.spacing = spacing or Spacing(PER_SECOND_WITH_KEY if key else PER_SECOND)

    def ask(self, address: str) -> bytes:
        return patient(self.fetch, address, self.spacing, self.sleep)

    def _json(self, page: str, **given: str) -> dict:
        return json.loads(self.ask(f"{BASE}{page}?{urlencode({**given, 'retmode': 'json', **self.more})}"))

    def search(self, db: str, term: str) -> dict:
        return self._json("esearch.fcgi", db=db, term=term)

    def summary(self, db: str, ids: list[str]) -> dict:
        return self._json("esummary.fcgi", db=db, id=",".join(ids))

    def links(self, source: str, db: str, id_: str) -> dict:
        return self._json("elink.fcgi", dbfrom=source, db=db, id=id_)

    def match(self, line: str) -> str:
        return self.ask(f"{BASE}ecitmatch.cgi?{urlencode({'db': 'pubmed', 'retmode': 'xml', 'bdata': line, **self.more})}").decode()

    def study(self, accession: str) -> dict:
        return json.loads(self.fetch(STUDIES + accession))
