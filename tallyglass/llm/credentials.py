"""Secret scans with multipart linking: weak candidates count only beside the parts that complete a credential."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallyglass.llm.common import table

NAME = "op10_secrets"
#: Code points around a candidate within which the other parts must lie.
SCOPE = 240

# The base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Weak parts: each too common to be reported alone.
IDENTIFIER = re.compile(
    r"""(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{16,}|(?:user(?:name)?|login|client_?id|account|key_?id|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.+-]{3,}""", re.IGNORECASE | re.ASCII
)
SECRET = re.compile(
    r"""(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}={0,2}|(?i:pwd|pass|passphrase|auth|credential|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.ASCII
)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>|]{3,}|(?:host|hostname|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{3,}""", re.IGNORECASE | re.ASCII)

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: A text without any of these holds no base span and no secret to link; what it finds beyond that is sorted out later.
_WORTH = r"""(?i)(password|passwd|secret|token|api_?key|pwd|pass|passphrase|auth|credential|private_?key)["']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/]{32}"""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and non-overlapping for each kind; matches that are too short are passed over."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(found)


def near(spans: np.ndarray, others: np.ndarray, scope: int) -> np.ndarray:
    """Interval join: which spans have one of `others` within `scope` of them.

    Those that start before the right edge, less those that end before the left edge, are the ones that meet; sorted
    edges give both counts, so no pairs are made.
    """
    starts, ends = np.sort(others[:, 0]), np.sort(others[:, 1])
    return np.searchsorted(starts, spans[:, 1] + scope, "right") > np.searchsorted(ends, spans[:, 0] - scope, "left")


def linked(text: str, base: list[tuple[int, int, int]], scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """Weak spans whose complementary parts lie within the scope.

    A weak secret needs an identifier or an endpoint, a weak identifier needs a secret, an endpoint needs an identifier
    and a secret. Base spans take part: access identifies, assign and hex are secrets. Weak spans inside base ones of
    the same role aren't told twice.
    """
    def weak(pattern):
        return np.array([m.span() for m in pattern.finditer(text)], np.int64).reshape(-1, 2)

    def of(*kinds):
        return np.array([(s, e) for s, k, e in base if k in kinds], np.int64).reshape(-1, 2)

    secrets, identifiers, endpoints = weak(SECRET), weak(IDENTIFIER), weak(ENDPOINT)
    strong_secrets, strong_ids = of(0, 2), of(1)
    secrets = secrets[~near(secrets, strong_secrets, -1)] if len(secrets) else secrets
    identifiers = identifiers[~near(identifiers, strong_ids, -1)] if len(identifiers) else identifiers
    # an endpoint or a secret isn't its own identifier
    all_secrets, all_ids = np.concatenate([secrets, strong_secrets]), np.concatenate([identifiers, strong_ids])
    out = []
    for kind, spans, keep in (
        (3, identifiers, near(identifiers, all_secrets, scope)),
        (4, secrets, near(secrets, all_ids, scope) | near(secrets, endpoints, scope)),
        (5, endpoints, near(endpoints, all_ids, scope) & near(endpoints, all_secrets, scope)),
    ):
        out += [(int(s), kind, int(e)) for (s, e), k in zip(spans, keep, strict=True) if k]
    return out


def _joined(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Everything is found in one pass
    where the texts are read, as scopes never reach over a document.

    Null and empty texts have no spans; overlapping kinds are all told; repeated rows are scanned each; an empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    def run(batches):
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, digests, spans = np.zeros((n, 4), np.int64), [none] * n, [""] * n
            worth = pc.fill_null(pc.match_substring_regex(batch.column(1), _WORTH), False).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(worth):
                text = batch.column(1)[i].as_py()
                base = base_spans(text)
                more = linked(text, base, scope)
                counts[i] = [*(sum(k == j for _, k, _ in base) for j in range(3)), len(more)]
                digests[i], spans[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts.T.copy()], pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
