"""Streaming sources: growing text files, and datagrams of a port.

Offsets are bytes per file. Only lines that end are read; a file that shrinks is read anew;
blank lines are skipped. Offsets are planned on the driver and committed with the stream's
checkpoint, after the rows were written.
"""

from __future__ import annotations

import glob
import json
import os
import socket

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import LongType, StringType, StructField, StructType


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def complete_end(path: str, start: int, block: int = 1 << 20) -> int:
    """The place after the last line that ends, from the end backwards."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        at = size
        while at > start:
            low = max(start, at - block)
            f.seek(low)
            nl = f.read(at - low).rfind(b"\n")
            if nl >= 0:
                return low + nl + 1
            at = low
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pattern = options["path"]

    def _ends(self, before: dict[str, int]) -> dict[str, int]:
        ends = {}
        for p in sorted(glob.glob(self.pattern)):
            start = before.get(p, 0)
            start = 0 if os.path.getsize(p) < start else start
            ends[p] = complete_end(p, start)
        return ends

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._ends({}))}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        pieces = []
        for p, e in new.items():
            s = old.get(p, 0)
            s = 0 if e < s else s
            if e > s:
                pieces.append(Piece(p, s, e))
        return pieces

    def read(self, partition: Piece):
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            for line in f.read(partition.end - partition.start).splitlines(keepends=True):
                text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if text.strip():
                    yield (partition.path, at, text)
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "huntframe_tail"

    def schema(self) -> StructType:
        return StructType([StructField("path", StringType()), StructField("offset", LongType()), StructField("raw", StringType())])

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, pattern: str):
    """Lines appended to the files of a pattern, as a stream."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("huntframe_tail").option("path", pattern).load()


def socket_lines(spark: SparkSession, host: str, port: int):
    """Newline-framed lines of a TCP peer, for tests."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


class Spool:
    """Numbered frames in a file, written and synchronised before anyone sees them, dropped once they are committed."""

    def __init__(self, folder: str | None):
        self.path = os.path.join(folder, "frames.jsonl") if folder else None
        self.kept: dict[int, str] = {}
        self.next = 0
        if self.path:
            os.makedirs(folder, exist_ok=True)
            if os.path.exists(self.path):
                with open(self.path, encoding="utf-8") as f:
                    for line in f:
                        if line.endswith("\n"):  # a line cut short was never seen by anyone
                            n, text = json.loads(line)
                            self.next = max(self.next, n + 1)
                            if text is not None:
                                self.kept[n] = text

    def add(self, frames: list[str]) -> None:
        new = list(enumerate(frames, self.next))
        if new and self.path:
            self._write(new, "a")
        self.kept.update(new)
        self.next += len(new)

    def forget(self, before: int) -> None:
        gone = [n for n in self.kept if n < before]
        for n in gone:
            del self.kept[n]
        if gone and self.path:  # the number goes on where it was, also if nothing is left
            self._write([*sorted(self.kept.items()), (self.next - 1, None)] if self.next - 1 not in self.kept else sorted(self.kept.items()), "w")

    def _write(self, frames: list[tuple[int, str | None]], mode: str) -> None:
        path = self.path if mode == "a" else self.path + ".new"
        with open(path, mode, encoding="utf-8") as f:
            f.writelines(json.dumps([n, t]) + "\n" for n, t in frames)
            f.flush()
            os.fsync(f.fileno())
        if mode == "w":
            os.replace(path, self.path)


class Listener:
    """A port that takes datagrams, one frame each, or connections with one frame a line."""

    def __init__(self, protocol: str, host: str, port: int):
        self.tcp = protocol == "tcp"
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_STREAM if self.tcp else socket.SOCK_DGRAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((host, port))
        self.socket.setblocking(False)
        self.open: dict[socket.socket, bytes] = {}
        if self.tcp:
            self.socket.listen()

    def _pending(self, sock: socket.socket, take):
        while True:
            try:
                yield take(sock)
            except BlockingIOError:
                return

    def frames(self) -> list[str]:
        """All that has come since the last call; blank lines are no frames."""
        if not self.tcp:
            return [d.decode("utf-8", "replace") for d in self._pending(self.socket, lambda s: s.recv(65_536))]
        for peer, _ in self._pending(self.socket, lambda s: s.accept()):
            peer.setblocking(False)
            self.open[peer] = b""
        out: list[bytes] = []
        for peer in list(self.open):
            try:
                for data in self._pending(peer, lambda s: s.recv(65_536)):
                    lines = (self.open[peer] + data).split(b"\n")
                    self.open[peer] = lines.pop() if data else b""  # lines then hold the rest
                    out += lines
                    if not data:  # the peer has closed; what it left without a line end is a frame
                        peer.close()
                        del self.open[peer]
                        break
            except OSError:
                self.open.pop(peer, None)
        return [t for line in out if (t := line.rstrip(b"\r").decode("utf-8", "replace")).strip()]


class FrameReader(SimpleDataSourceStreamReader):
    """Frames of a port, kept in the spool until the stream has committed them."""

    def __init__(self, options: dict[str, str]):
        # Spark makes several readers; the one that reads is the one that listens.
        self.options, self.listener, self.spool = options, None, None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _spool(self) -> Spool:
        if self.spool is None:
            self.spool = Spool(self.options.get("spool"))
        return self.spool

    def read(self, start: dict):
        if self.listener is None:
            self.listener = Listener(self.options.get("protocol", "udp"), self.options.get("host", "127.0.0.1"), int(self.options["port"]))
        spool = self._spool()
        spool.next = max(spool.next, int(start["n"]))
        spool.add(self.listener.frames())
        return iter([(i, spool.kept[i]) for i in range(int(start["n"]), spool.next) if i in spool.kept]), {"n": spool.next}

    def readBetweenOffsets(self, start: dict, end: dict):
        kept = self._spool().kept
        return iter([(i, kept[i]) for i in range(int(start["n"]), int(end["n"])) if i in kept])

    def commit(self, end: dict) -> None:
        self._spool().forget(int(end["n"]))


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "huntframe_frames"

    def schema(self) -> StructType:
        return StructType([StructField("n", LongType()), StructField("raw", StringType())])

    def simpleStreamReader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options)


def frames(spark: SparkSession, port: int, host: str = "127.0.0.1", protocol: str = "udp", spool: str | None = None):
    """Frames of a syslog listener (``udp`` or ``tcp``) as a stream; the listener runs beside the driver.

    ``spool`` is a folder that outlives the driver: with it, frames that were received but not
    committed are read again after a restart. Without it they live in memory only.
    """
    spark.dataSource.register(FrameSource)
    reader = spark.readStream.format("huntframe_frames").option("host", host).option("port", port).option("protocol", protocol)
    return (reader.option("spool", spool) if spool else reader).load()


def datagrams(spark: SparkSession, port: int, host: str = "127.0.0.1", spool: str | None = None):
    return frames(spark, port, host, "udp", spool)
