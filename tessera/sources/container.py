"""Tagged container of audio, video and caption frames: a Spark data source (batch reader and writer) and its byte layout.

Little-endian layout: file header (magic, content bits, metadata size), an audio, a video and a caption header as the content bits say, frames of a tag byte and a 24-bit size each, and metadata at the
end. A file is one partition: its frames can only be found one after the other, so that files are what is read in parallel.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.sources.sinks import write_file

# Magic word, content bits, frame tags and header layouts.
MAGIC = 0x76326830
AUDIO, VIDEO, CAPTIONS = 1, 2, 4
TAGS = {"pixels": 1, "colormap": 2, "audio": 3, "caption": 4}
FILE_HEAD, AUDIO_HEAD, VIDEO_HEAD, CAPTION_HEAD = "<IBBH", "<HIHBBhHH4B", "<HIHHBBBBHI4B", "<HH"

SUFFIX = ".framebox"
SCHEMA = "path string, frame_no int, kind string, payload binary"
_NAMES = {v: k for k, v in TAGS.items()}


def build(frames: list[tuple[str, bytes]], metadata: bytes = b"", rate: float = 0.0, width: int = 0, height: int = 0, bits: int = 0, sample_rate: int = 0, channels: int = 0, sample_bits: int = 0,
          video_steps: tuple[int, ...] = (), audio_steps: tuple[int, ...] = (), color_map_bits: int = 0, color_map_size: int = 0, swapped: int = 0, video_memory: int = 0, audio_offset: int = 0,
          audio_memory: int = 0) -> bytes:
    """Bytes of a container; ``*_steps`` name the processing steps that a reader must undo, at most four; ``*_memory`` is the most memory that undoing them takes.

    Counts of frames, samples and colour maps are taken from the frames; ``*_memory`` is 0 where a single step gives the data, ``audio_offset`` counts samples.
    """
    if len(metadata) > 65535:
        raise ValueError("metadata takes at most 65535 bytes")
    if len(video_steps) > 4 or len(audio_steps) > 4:
        raise ValueError("a reader undoes at most four steps")
    kinds = [k for k, _ in frames]
    content = (AUDIO if "audio" in kinds else 0) | (VIDEO if "pixels" in kinds else 0) | (CAPTIONS if "caption" in kinds else 0)
    steps = lambda s: (*s, *[255] * (4 - len(s)))
    out = bytearray(struct.pack(FILE_HEAD, MAGIC, content, 0, len(metadata)))
    if content & AUDIO:
        n = sum(len(p) for k, p in frames if k == "audio") // max(1, channels * sample_bits // 8)
        out += struct.pack(AUDIO_HEAD, kinds.count("audio"), n, sample_rate, channels, sample_bits, audio_offset, audio_memory, 0, *steps(audio_steps))
    if content & VIDEO:
        out += struct.pack(VIDEO_HEAD, kinds.count("pixels"), round(rate * 65536), width, height, bits, color_map_bits, color_map_size & 255, swapped, kinds.count("colormap"), video_memory, *steps(video_steps))
    if content & CAPTIONS:
        out += struct.pack(CAPTION_HEAD, kinds.count("caption"), 0)
    for kind, payload in frames:
        if len(payload) >= 1 << 24:
            raise ValueError("a frame takes less than 16 MiB")
        out += struct.pack("<I", TAGS[kind] | len(payload) << 8) + payload
    return bytes(out) + metadata


def header_fields(heads: dict) -> dict:
    """The fields of parsed headers by name, as ``build`` takes them."""
    out: dict = {}
    if a := heads.get("audio"):
        out |= {"sample_rate": a[2], "channels": a[3], "sample_bits": a[4], "audio_offset": a[5], "audio_memory": a[6], "audio_steps": [s for s in a[8:12] if s != 255]}
    if v := heads.get("video"):
        out |= {"rate": v[1] / 65536, "width": v[2], "height": v[3], "bits": v[4], "color_map_bits": v[5], "color_map_size": v[6] or (256 if v[5] else 0), "swapped": v[7], "video_memory": v[9], "video_steps": [s for s in v[10:14] if s != 255]}
    return out


def caption_payload(start: float, end: float, text: str) -> bytes:
    """Caption frame: 16.16 fixed-point times and zero-terminated text."""
    return struct.pack("<ii", round(start * 65536), round(end * 65536)) + text.encode() + b"\0"


def caption_of(payload: bytes) -> tuple[float, float, str]:
    a, b = struct.unpack_from("<ii", payload)
    return a / 65536, b / 65536, payload[8:].split(b"\0")[0].decode()


def parse(data: bytes) -> tuple[dict, list[tuple[str, bytes]], bytes]:
    """(headers, frames, metadata) of a container."""
    try:
        magic, content, _, meta = struct.unpack_from(FILE_HEAD, data)
        if magic != MAGIC:
            raise ValueError("no such container")
        at, heads = struct.calcsize(FILE_HEAD), {"content": content}
        for bit, name, layout in ((AUDIO, "audio", AUDIO_HEAD), (VIDEO, "video", VIDEO_HEAD), (CAPTIONS, "captions", CAPTION_HEAD)):
            if content & bit:
                heads[name] = struct.unpack_from(layout, data, at)
                at += struct.calcsize(layout)
        frames, end = [], len(data) - meta
        while at < end:
            word = struct.unpack_from("<I", data, at)[0]
            at += 4
            size = word >> 8
            if word & 255 not in _NAMES or at + size > end:
                raise ValueError("broken frame")
            frames.append((_NAMES[word & 255], data[at : at + size]))
            at += size
    except struct.error:
        raise ValueError("file ends early") from None
    return heads, frames, data[end:]


def _files(path: str):
    """(file system, path on it); paths without a scheme are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, at = _files(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found = [x.path for x in system.get_file_info(fs.FileSelector(at)) if x.path.endswith(SUFFIX)]
        elif info.type == fs.FileType.File:
            found = [at]
        else:
            raise ValueError(f"no such file: {self.path}")
        return [_File(scheme + f) for f in sorted(found)]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, at = _files(partition.path)
        with system.open_input_stream(at) as f:
            heads, frames, meta = parse(f.read())
        for i, (kind, payload) in enumerate(frames):
            yield partition.path, i, kind, payload
        yield partition.path, len(frames), "header", json.dumps(header_fields(heads)).encode()
        if meta:
            yield partition.path, len(frames) + 1, "metadata", meta


class _Writer(DataSourceWriter):
    """One file for each partition: its rows are frames in order. The headers' fields are options; a row of kind ``header`` with such fields as JSON goes before them."""

    def __init__(self, path: str, options: dict) -> None:
        self.path, self.options = path, options

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        frames, meta, heads = [], b"", dict(self.options)
        for r in rows:
            if r["kind"] == "metadata":
                meta = bytes(r["payload"])
            elif r["kind"] == "header":
                heads.update({k: v for k, v in json.loads(bytes(r["payload"])).items() if k in HEADER_FIELDS})
            else:
                frames.append((r["kind"], bytes(r["payload"])))
        if frames or meta:
            write_file(f"{self.path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}{SUFFIX}", build(frames, meta, **heads))  # a task that is run again replaces its own file
        return WriterCommitMessage()


#: Fields of the headers that a writer takes, as options or in a header row.
HEADER_FIELDS = {
    "rate": float, "width": int, "height": int, "bits": int, "color_map_bits": int, "color_map_size": int, "swapped": int, "video_memory": int, "sample_rate": int, "channels": int, "sample_bits": int,
    "audio_offset": int, "audio_memory": int, "video_steps": list, "audio_steps": list,
}


def _option(name: str, text: str):
    kind = HEADER_FIELDS[name]
    return tuple(int(x) for x in text.split(",") if x.strip()) if kind is list else kind(text)


class ContainerSource(DataSource):
    """``spark.read.format("framebox").load(path)``, after ``spark.dataSource.register(ContainerSource)``. Writing takes the fields of the headers as options, lists of steps as numbers with commas."""

    @classmethod
    def name(cls) -> str:
        return "framebox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        given = {k.lower(): v for k, v in dict(self.options).items()}
        return _Writer(self.options["path"], {n: _option(n, given[n.replace("_", "")] if n.replace("_", "") in given else given[n]) for n in HEADER_FIELDS if n in given or n.replace("_", "") in given})
