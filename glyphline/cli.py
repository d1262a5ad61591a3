"""``python -m glyphline.cli VERB ...``: the operators on single files, without Spark."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .config import Engine
from .kernels import lexer, text
from .kernels.vocab import LEX_PROFILES, PackError, base_detector
from .sources import packs

#: Verbs and their arguments: packs are files; Unicode tables are the installed ones, so that no pack names them.
VERBS = {
    "validate": ["pack"],
    "encode": ["model", "input", "languages*"],
    "roundtrip": ["model", "input", "languages*"],
    "roundtrip-languages": ["model", "input", "languages*"],
    "roundtrip-auto": ["model", "detector", "input", "languages*"],
    "encode-u32": ["model", "input", "output", "languages*"],
    "decode-u32": ["model", "ids", "output"],
    "analyze": ["model", "input", "languages*"],
    "analyze-languages": ["model", "input", "languages*"],
    "analyze-auto": ["model", "detector", "input", "languages*"],
    "analyze-span-auto": ["model", "detector", "input", "languages*"],
    "analyze-security": ["model", "input"],
    "analyze-normalization": ["model", "mode", "input"],
    "analyze-lexer": ["model", "lexer", "input"],
    "fingerprint": ["model", "languages*"],
    "fingerprint-languages": ["model", "languages*"],
    "fingerprint-auto": ["model", "detector", "languages*"],
    "fingerprint-security": ["model"],
    "fingerprint-normalization": ["model"],
    "fingerprint-lexer": ["model", "lexer"],
    "graphemes": ["input"],
    "detect": ["detector", "input"],
    "routes": ["input"],
    "security": ["input"],
    "lexer": ["lexer", "input"],
    "normalize": ["mode", "input", "output"],
    "normalize-map": ["mode", "input"],
}


def _read(path: str) -> bytes:
    return Path(path).read_bytes()


def _detector(name: str):
    """A detector's pack, or "base" for the built-in one."""
    return base_detector() if name == "base" else packs.read_detector(_read(name))


def _lexer(name: str):
    """A lexer's pack, or the name of a built-in profile."""
    return LEX_PROFILES.get(name) or packs.read_lexer(_read(name))


def _engine(a) -> Engine:
    """The model with what the verb's packs and name attach."""
    out = Engine(packs.read_vocabulary(_read(a.model)))
    for path in getattr(a, "languages", []):
        out = out.with_language(packs.read_language(_read(path)))
    if hasattr(a, "detector"):
        out = out.with_detector(_detector(a.detector))
    if hasattr(a, "lexer"):
        out = out.with_lexer(_lexer(a.lexer))
    what = a.verb.partition("-")[2]
    return out.with_security() if what == "security" else out.with_normalization() if what == "normalization" else out


def _encoded(e: Engine, data: bytes, auto: bool, spans: bool):
    """(ids, lengths) by all languages, or by the detected one of the whole or of each span."""
    if not auto:
        return e.encoder().encode(data)
    ids, lengths = [], []
    for kind, start, n in text.routes(data) if spans else [(1, 0, len(data))]:
        part = data[start : start + n]
        tag = e.detector.detect(part)[3] if kind else None
        found = e.encoder([tag] if tag in e.tags else []).encode(part)
        ids += found[0]
        lengths += found[1]
    return ids, lengths


def _mode(name: str) -> str:
    if name not in text.MODES:
        raise PackError(f"modes are {', '.join(text.MODES)}", 1)
    return name


def _show(rows) -> int:
    for row in rows:
        print(*row)
    return 0


def _run(a) -> int:
    verb, _, what = a.verb.partition("-")
    if verb == "validate":
        return _show((kind, len(body)) for kind, body in packs.scan(_read(a.pack)))
    if verb == "fingerprint":
        return _show([(_engine(a).fingerprint().hex(),)])
    if verb == "decode":
        try:
            Path(a.output).write_bytes(_engine(a).encoder().decode(packs.unpack_u32(_read(a.ids))))
        except KeyError:
            return 6
        return 0
    data = _read(a.input)
    if verb in ("encode", "roundtrip", "analyze"):
        e = _engine(a)
        ids, lengths = _encoded(e, data, what.endswith("auto"), what == "span-auto")
        if verb == "roundtrip":
            return 0 if e.encoder().decode(ids) == data else 12
        if what == "u32":
            Path(a.output).write_bytes(packs.pack_u32(ids))
            return 0
        if verb == "encode":
            return _show([ids])
        at = [0]
        for n in lengths:
            at.append(at[-1] + n)
        cost = e.encoder().base_cost
        _show((i, s, n, cost[i]) for i, s, n in zip(ids, at, lengths, strict=False))
        more = {
            "security": lambda: text.findings(data, text.script_table(), text.flag_table()),
            "normalization": lambda: text.normalize_view(data, _mode(a.mode))[1],
            "lexer": lambda: lexer.lex(e.lexer, data),
        }
        return _show(more[what]()) if what in more else 0
    if verb == "normalize" and not what:
        Path(a.output).write_bytes(text.normalize(data, _mode(a.mode)))
        return 0
    rows = {
        "graphemes": lambda: text.graphemes(data),
        "routes": lambda: text.routes(data),
        "detect": lambda: [_detector(a.detector).detect(data)],
        "security": lambda: text.findings(data, text.script_table(), text.flag_table()),
        "lexer": lambda: lexer.lex(_lexer(a.lexer), data),
        "normalize": lambda: text.normalize_view(data, _mode(a.mode))[1],
    }
    return _show(rows[verb]())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glyphline")
    parser.add_argument("--version", action="version", version=f"glyphline {text.tables_version()}")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, names in VERBS.items():
        p = verbs.add_parser(verb)
        for name in names:
            p.add_argument(name.rstrip("*"), nargs="*" if name.endswith("*") else None)
    try:
        return _run(parser.parse_args(argv))
    except PackError as e:
        print(e, file=sys.stderr)
        return e.status
    except OSError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
