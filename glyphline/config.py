"""An engine: an immutable configuration that all operators take."""

from __future__ import annotations

import dataclasses
import json
import struct
from dataclasses import dataclass

from .kernels import records, text
from .kernels.encode import Encoder
from .kernels.vocab import Detector, Language, LexProfile, PackError, Vocabulary
from .sources import packs

SEMANTICS_VERSION = records.SEMANTICS
STATUS = (
    "ok",
    "invalid argument",
    "input or output failed",
    "invalid pack",
    "out of memory",
    "overflow",
    "unknown token id",
    "internal error",
    "conflict",
    "resource limit",
    "unsupported",
    "not found",
    "integrity failure",
    "invalid state",
    "untrusted",
    "revoked",
)
OK, INVALID, IO, BAD_PACK, MEMORY, OVERFLOW, UNKNOWN_ID, INTERNAL, CONFLICT, LIMIT, UNSUPPORTED, NOT_FOUND, INTEGRITY, STATE, UNTRUSTED, REVOKED = range(16)
CAPABILITIES = (
    "model graphemes language_packs detector security normalization streaming online_streaming editable_document incremental_document resync_document "
    "token_document lexer semantic subbyte block_plan packed_model content_cache cache_backend runtime_policy token_document_serialization parallel_batch observability span_routing"
).split()


def status_text(status: int) -> str:
    return STATUS[status] if 0 <= status < len(STATUS) else "unknown status"


@dataclass(frozen=True)
class Limits:
    """Ceilings in bytes and tokens; what is above them has status 9 and no result."""

    max_input_bytes: int = 1 << 30
    max_output_tokens: int = 1 << 30
    max_document_bytes: int = 1 << 30

    def __post_init__(self):
        if min(dataclasses.astuple(self)) < 1:
            raise PackError("limits must be positive", INVALID)


LOW_MEMORY = Limits(64 << 20, 64 << 20, 32 << 20)


@dataclass(frozen=True)
class Engine:
    """Methods return a changed copy; a sealed engine can't be changed any more."""

    vocabulary: Vocabulary
    languages: tuple[Language, ...] = ()
    detector: Detector | None = None
    security: bool = False
    normalization: bool = False
    lexer: LexProfile | None = None
    limits: Limits = Limits()
    sealed: bool = False

    def _change(self, **what) -> Engine:
        if self.sealed:
            raise PackError("the engine is sealed", STATE)
        return dataclasses.replace(self, **what)

    def _attach(self, name: str, value) -> Engine:
        if self.sealed:
            raise PackError("the engine is sealed", STATE)
        if getattr(self, name):
            raise PackError(f"{name} is attached already", CONFLICT)
        return dataclasses.replace(self, **{name: value})

    def with_language(self, language: Language) -> Engine:
        if any(x.tag == language.tag for x in self.languages):
            raise PackError(f"language {language.tag} is attached already", CONFLICT)
        if len(self.languages) >= 64:
            raise PackError("64 languages at most", LIMIT)
        return self._change(languages=(*self.languages, language))

    def with_detector(self, detector: Detector) -> Engine:
        return self._attach("detector", detector)

    def with_security(self) -> Engine:
        return self._attach("security", True)

    def with_normalization(self) -> Engine:
        return self._attach("normalization", True)

    def with_lexer(self, profile: LexProfile) -> Engine:
        return self._attach("lexer", profile)

    def with_limits(self, limits: Limits) -> Engine:
        return self._change(limits=limits)

    def seal(self) -> Engine:
        return dataclasses.replace(self, sealed=True)

    @property
    def tags(self) -> list[str]:
        return [x.tag for x in self.languages]

    def deltas(self, tags: list[str] | None = None) -> dict[bytes, int]:
        """Sum of the deltas of the attached languages, or of those of some tags."""
        out: dict[bytes, int] = {}
        for x in self.languages:
            if tags is None or x.tag in tags:
                for s, d in x.deltas:
                    out[s] = out.get(s, 0) + d
        return out

    def encoder(self, tags: list[str] | None = None) -> Encoder:
        """The encoder of all attached languages, or of those of some tags."""
        return Encoder(self.vocabulary, self.deltas(tags))

    def capabilities(self) -> dict[str, bool]:
        have = dict.fromkeys(CAPABILITIES, True)
        viterbi = self.vocabulary.algorithm == 0
        have |= {"language_packs": bool(self.languages), "detector": self.detector is not None, "security": self.security, "normalization": self.normalization, "lexer": self.lexer is not None, "semantic": self.lexer is not None}
        return have | {"online_streaming": viterbi, "incremental_document": viterbi, "resync_document": viterbi, "span_routing": self.detector is not None}

    def fingerprint(self) -> bytes:
        """Identity of everything that encoding depends on; the order of languages doesn't matter."""
        extra = {}
        if self.detector:
            extra["detector"] = records.sha256(packs.write_detector(self.detector))
        if self.security:
            extra["security"] = records.sha256(text.tables_version().encode())
        if self.normalization:
            extra["normalization"] = records.sha256(text.tables_version().encode(), b"normalization")
        if self.lexer:
            extra["lexer"] = records.sha256(packs.write_lexer(self.lexer))
        return records.fingerprint(packs.write_vocabulary(self.vocabulary), text.tables_version(), [records.sha256(packs.write_language(x)) for x in self.languages], extra)

    def runtime_identity(self) -> bytes:
        """Identity of the fingerprint and the limits."""
        return records.sha256(self.fingerprint(), struct.pack("<3Q", *dataclasses.astuple(self.limits)), struct.pack("<II", 0, 1))

    def describe(self) -> str:
        """The configuration as canonical JSON."""
        return json.dumps({"fingerprint": self.fingerprint().hex(), "semantics": SEMANTICS_VERSION, "languages": sorted(self.tags), "capabilities": sorted(k for k, v in self.capabilities().items() if v), "sealed": self.sealed}, sort_keys=True)
