"""Structured Streaming: keyed state of open streams and of edited documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import LIMIT, Engine
from ..kernels.stream import IncrementalDocument, OnlineStream

TOKENS = "stream string, token_no long, token_id long, start long, length long"
#: Pending bytes, bytes and tokens given out, next chunk, chunks that came too early.
STATE = "pending binary, given long, tokens long, next long, early array<struct<seq:long,chunk:binary,last:boolean>>"


def online_tokens(chunks: DataFrame, engine: Engine, max_pending: int = 1 << 20, idle_ms: int = 0, max_early: int = 16 << 20) -> DataFrame:
    """Tokens of streaming chunks (stream string, seq long, chunk binary, last boolean).

    A token is given out once no further byte can change it. Chunks are taken in the order of seq
    from 0 on; one that comes early waits for those before it, one that comes again is left out.
    Chunks that wait may have ``max_early`` bytes: a stream that would hold more ends with one row
    of token_no -1 and token_id 9 (resource limit), and what comes for it later is left out.
    The chunk marked last ends its stream. Tokens are numbered within the stream, so that a batch
    that is run again gives the same rows. idle_ms: if given, a stream that gets nothing for so
    long is forgotten, as a session that expires.
    """
    encoder = engine.encoder()

    def step(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        pending, given, number, following, early = state.get if state.exists else (b"", 0, 0, 0, [])
        waiting = {e["seq"]: (e["chunk"], e["last"]) for e in [x if isinstance(x, dict) else x.asDict() for x in early]}
        for frame in frames:
            for seq, chunk, last in zip(frame["seq"], frame["chunk"], frame["last"], strict=True):
                if seq >= following:
                    waiting.setdefault(int(seq), (bytes(chunk or b""), bool(last)))
        stream, out, ended = OnlineStream(encoder, max_pending, bytes(pending)), [], False
        while following in waiting and not ended:
            chunk, ended = waiting.pop(following)
            following += 1
            tokens = stream.push(bytes(chunk))
            for i, n in [*tokens, *(stream.finish() if ended else [])]:
                out.append((key[0], number, i, given, n))
                number, given = number + 1, given + n
        if sum(len(c) for c, _ in waiting.values()) > max_early:
            out.append((key[0], -1, LIMIT, given, 0))
            ended, following = True, 1 << 62
        if ended:
            # what is left of the state tells repeats of an ended stream
            waiting = {}
        state.update((stream.pending, given, number, following, [{"seq": s, "chunk": c, "last": e} for s, (c, e) in sorted(waiting.items())]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["stream", "token_no", "token_id", "start", "length"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    rows = chunks.select("stream", "seq", "chunk", "last")
    return rows.groupBy("stream").applyInPandasWithState(step, TOKENS, STATE, "append", timeout)


EDITED = "doc string, seq long, length long, n_tokens long, reprocessed long, reused long"


def edited_documents(edits: DataFrame, engine: Engine) -> DataFrame:
    """Metrics of each edit of streaming (doc string, seq long, start long, delete long, insert binary).

    The state holds a document's bytes and tokens; tokens well before an edit are kept.
    """
    encoder = engine.encoder()

    def step(key, frames, state):
        import pandas as pd

        doc = IncrementalDocument(encoder)
        if state.exists:
            data, ids, lengths = state.get
            doc.data, doc.ids, doc.lengths = bytes(data), list(ids), list(lengths)
        rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.seq)
        out = []
        for r in rows:
            doc.edit(int(r.start), int(r.delete), bytes(r.insert or b""))
            out.append((key[0], r.seq, len(doc.data), len(doc.ids), doc.reprocessed, doc.reused))
        state.update((doc.data, doc.ids, doc.lengths))
        yield pd.DataFrame(out, columns=["doc", "seq", "length", "n_tokens", "reprocessed", "reused"])

    rows = edits.select("doc", "seq", "start", "delete", "insert")
    return rows.groupBy("doc").applyInPandasWithState(step, EDITED, "data binary, ids array<long>, lengths array<long>", "append", GroupStateTimeout.NoTimeout)


def expired_after(df: DataFrame, column: str, idle: str) -> DataFrame:
    """Sessions of a stream's chunks by event time: the batch counterpart of idle expiry."""
    return df.groupBy("stream", F.session_window(column, idle)).agg(F.count("*").alias("n_chunks"))
