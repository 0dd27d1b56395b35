"""Batches on remotes: folders of any file system that Spark knows, and services over HTTP.

A batch is there once its manifest is, which is written last.  What is there
already is left alone if it is the same, and is an error if it isn't.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from ..config import Service, Store
from ..functions import filesystem as FS
from ..functions.payloads import dumps, loads
from ..schemas import MANIFEST
from . import archive as A
from . import maintenance as K
from .batchindex import write_index
from .policy import need

ATTEMPTS, TIMEOUT, MAX_LIST = 4, 60.0, 8 << 20


def retryable(status: int) -> bool:
    return status == 429 or status >= 500


class FolderRemote:
    """``root/<batch>/...`` on a file system of Spark's; credentials are that file system's matter."""

    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.root = spark, store.checked().uri.rstrip("/")
        #: Manifests by batch; one that is there never changes.
        self.known: dict[str, dict] = {}

    def manifests(self) -> list[dict]:
        """All manifests that are there, checked; only those that aren't known yet are read."""
        names = [n for n, _ in FS.folders(self.spark, self.root) if not n.startswith(".")]
        new = {n: loads(FS.read(self.spark, f"{self.root}/{n}/manifest.json")) for n in names if n not in self.known and FS.exists(self.spark, f"{self.root}/{n}/manifest.json")}
        _well_formed(self.spark, list(new.values()))
        need(all(m["batch_id"] == n for n, m in new.items()), "a manifest of the remote lies in another batch's folder")
        self.known = {n: m for n, m in (self.known | new).items() if n in names}
        return [self.known[n] for n in sorted(self.known)]

    def upload(self, batch: str, manifest: dict) -> None:
        """Claim the batch's id, copy its files in tasks, and publish the manifest.

        Of several that claim an id at once the file system lets one make the
        claim; the others go on if theirs is the same, and stop if it isn't.
        """
        own, raw = f"{self.root}/{manifest['batch_id']}", dumps(manifest).encode()
        if not FS.create(self.spark, f"{own}/.claim", raw):
            need(self._claimed(f"{own}/.claim", raw) == raw, f"the remote has another batch {manifest['batch_id']}")
        if FS.exists(self.spark, f"{own}/manifest.json"):
            return
        found = FS.copied(self.spark, batch, own, [f["path"] for f in manifest["files"]])
        need({(p, d) for p, _, d in found} == {(f["path"], f["sha256"]) for f in manifest["files"]}, "a file reached the remote other than it was sent")
        FS.write(self.spark, f"{own}/manifest.json", raw)

    def _claimed(self, claim: str, raw: bytes) -> bytes:
        """What a claim says; one that another is still writing is waited for."""
        for _ in range(20):
            found = FS.read(self.spark, claim)
            if found == raw or not raw.startswith(found):
                break
            time.sleep(0.1)
        return found

    def fetch(self, manifest: dict, target: str) -> set[tuple[str, int, str]]:
        return FS.copied(self.spark, f"{self.root}/{manifest['batch_id']}", target, [f["path"] for f in manifest["files"]])


def _well_formed(spark: SparkSession, found: list[dict]) -> None:
    from .catalog import validate_manifests

    if found:
        wrong = validate_manifests(spark.createDataFrame(found, MANIFEST)).where("not valid").first()
        need(wrong is None, f"a manifest of the remote isn't well formed: {wrong}")


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


class ServiceRemote:
    """The service's protocol: register a batch, put its files, commit; list committed batches page by page."""

    def __init__(self, spark: SparkSession, service: Service, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.sleep = spark, sleep
        self.url = f"{service.checked().url.rstrip('/')}/v1/archives/{urllib.parse.quote(service.archive, safe='')}"
        self.token = os.environ.get(service.token_env, "").strip()
        need(bool(self.token), f"the variable {service.token_env} holds no token")
        self.opener = urllib.request.build_opener(_NoRedirects)

    def request(self, method: str, path: str, body: bytes | Path | None = None, headers: dict | None = None):
        """An open reply; asks again, up to four times, when the service is busy or can't be reached."""
        for attempt in range(1, ATTEMPTS + 1):
            own = {"authorization": f"Bearer {self.token}", **(headers or {})}
            data = body
            if isinstance(body, Path):
                data, own["content-length"] = open(body, "rb"), str(body.stat().st_size)
            try:
                return self.opener.open(urllib.request.Request(f"{self.url}/{path}", data, own, method=method), timeout=TIMEOUT)
            except urllib.error.HTTPError as e:
                if not retryable(e.code) or attempt == ATTEMPTS:
                    raise ValueError(f"{method} of {path.split('?')[0]} was answered with status {e.code}") from None
            except OSError:
                if attempt == ATTEMPTS:
                    raise ValueError(f"the remote couldn't be reached in {ATTEMPTS} attempts") from None
            finally:
                if isinstance(body, Path):
                    data.close()
            self.sleep(0.25 * 2 ** (attempt - 1))
        raise AssertionError

    def pages(self) -> Iterator[list[dict]]:
        after = ""
        while True:
            with self.request("GET", f"batches?after={urllib.parse.quote(after, safe='')}") as reply:
                raw = reply.read(MAX_LIST + 1)
            need(len(raw) <= MAX_LIST, "a page of the remote's list is too large")
            page = loads(raw)
            yield page["batches"]
            if page["next"] is None:
                return
            need(page["next"] > after, "the remote's list doesn't go on")
            after = page["next"]

    def manifests(self) -> list[dict]:
        found = [m for page in self.pages() for m in page]
        _well_formed(self.spark, found)
        return found

    def upload(self, batch: str, manifest: dict) -> None:
        own = _route(manifest)
        self.request("PUT", own, dumps(manifest).encode(), {"content-type": "application/json"}).close()
        for f in manifest["files"]:
            at = Path(batch.removeprefix("file://")) / f["path"]
            self.request("PUT", f"{own}/files/{urllib.parse.quote(f['path'])}", at, {"content-type": "application/octet-stream"}).close()
        self.request("POST", f"{own}/commit", b"").close()

    def fetch(self, manifest: dict, target: str) -> set[tuple[str, int, str]]:
        own = _route(manifest)
        for f in manifest["files"]:
            at = Path(target.removeprefix("file://")) / f["path"]
            at.parent.mkdir(parents=True, exist_ok=True)
            with self.request("GET", f"{own}/files/{urllib.parse.quote(f['path'])}") as reply, open(at, "wb") as out:
                shutil.copyfileobj(reply, out, 1 << 20)
        return {(r["path"], r["size"], r["sha256"]) for r in FS.digests(self.spark, target, [f["path"] for f in manifest["files"]]).collect()}


def _route(manifest: dict) -> str:
    return "batches/" + "/".join(urllib.parse.quote(manifest[k], safe="") for k in ("collector_id", "batch_id"))


def connect(spark: SparkSession, remote: Store | Service):
    return FolderRemote(spark, remote) if isinstance(remote, Store) else ServiceRemote(spark, remote)


def download(spark: SparkSession, remote, manifest: dict, cache: str) -> str:
    """The batch in the cache: what is there already is verified, what isn't is fetched, verified and put in place at once."""
    final = f"{cache}/{manifest['batch_id']}"
    if not FS.exists(spark, f"{final}/manifest.json"):
        tmp = f"{cache}/{A.STAGING}/{uuid.uuid4().hex}"
        try:
            found = remote.fetch(manifest, tmp)
            need(found == {(f["path"], f["size"], f["sha256"]) for f in manifest["files"]}, "what came from the remote isn't what its manifest says")
            write_index(spark, tmp, sum(s["records"] for s in manifest["sessions"]))
            FS.write(spark, f"{tmp}/manifest.json", dumps(manifest).encode())
            FS.move(spark, tmp, final)
        finally:
            FS.delete(spark, tmp)
    need(json.loads(FS.read(spark, f"{final}/manifest.json")) == json.loads(dumps(manifest)), "the cache holds another batch of that id")
    return final


def cached(spark: SparkSession, remote, cache: str, harness: str | None = None, session: str | None = None) -> str:
    """A local archive with the remote's active batches that can hold the session; only those are fetched."""
    listed = remote.manifests()
    gone = {(m["collector_id"], b) for m in listed for b in m["replaces"]}
    for m in listed:
        if (m["collector_id"], m["batch_id"]) in gone:
            FS.delete(spark, f"{cache}/{m['batch_id']}")  # the merge that replaced it is in the list
            continue
        if any((harness is None or s["harness"] == harness) and (session is None or s["session_id"] == session) for s in m["sessions"]):
            download(spark, remote, m, cache)
    return cache


def sync(spark: SparkSession, root: str, name: str, remote) -> list[str]:
    """Upload the active batches that a remote lacks, oldest first, each marked when it is there; gives their ids."""
    if not A.any_batch(spark, root):
        return []
    have = {r["batch_id"] for r in K.uploads(spark, root).where(f"remote = '{name}'" if "'" not in name else "false").collect()}
    out = []
    for r in K.active(spark, root).select("batch_id").orderBy("seq").collect():  # a catalog, not data
        if r["batch_id"] not in have:
            batch = f"{root}/{r['batch_id']}"
            remote.upload(batch, A.manifest(spark, batch))
            K.mark_uploaded(spark, root, name, [r["batch_id"]])
            out.append(r["batch_id"])
    return out
