"""Source URI resolution (A1): map a user URI to a Hadoop path Spark can read."""

from __future__ import annotations

#: Schemes that are read, and the Hadoop scheme that reads them.
READABLE = {"gs": "gs", "s3": "s3a", "s3a": "s3a"}


def resolve_uri(uri: str) -> str:
    """A bare path stays as it is, ``file:`` loses its host part, ``gs://`` and ``s3://`` go to their
    connectors (``s3a``), which the cluster must have; any other scheme raises ``ValueError``."""
    head, colon, rest = uri.partition(":")
    if not colon or "/" in head:
        return uri
    kind = head.lower()
    if kind == "file":
        path = rest[2:].partition("/")[2] if rest.startswith("//") else rest.lstrip("/")
        return f"file:///{path}"
    if kind not in READABLE or not rest.startswith("//"):
        raise ValueError(f"cannot read {uri}: known are bare paths, file, {', '.join(sorted(READABLE))}")
    return f"{READABLE[kind]}:{rest}"
