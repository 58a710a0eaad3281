"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: for each turn the turn mark, the role, a line end, the text,
the end mark and a line end. Inside roles and texts a backslash is doubled and one is put into
every control string, so no control string is left and the text can be read back. The rendered
conversation is encoded once, with character offsets; tokens belong to the loss mask if they
meet the text of an assistant turn, found by binary search among the sorted token spans, and
the mask in characters is where both spans meet.

Cases: null texts and roles count as empty; turns with the same number follow role, then text;
a null turn number comes first; repeated rows are repeated turns; a null conversation id is a
conversation; without rows there is no result; other columns are not used.
"""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TURN, END, LINE = "<|turn|>", "<|end|>", "<|line|>"
#: Roles whose texts are learned.
LEARNED = ("assistant",)
# Control strings of common templates; each is cut behind its first character.
_CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
RESULT = (
    "formatted string, ids array<int>, loss_mask array<boolean>, "
    "loss_spans array<struct<start:int,end:int>>, turns array<struct<start:int,end:int>>"
)


def escaped(text):
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescaped(text):
    """Column: the text that was escaped."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def rendered(turns):
    """The formatted text, and (start, end) of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = TURN + escaped(role or "").replace("\n", LINE) + "\n"
        body = escaped(text or "")
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def masked(offsets, spans):
    """Mask of the tokens that meet a span, and the parts of the spans that tokens cover, merged."""
    start, end = (np.array([o[i] for o in offsets], dtype=np.int64) for i in (0, 1))
    mask, covered = np.zeros(len(offsets), bool), []
    for low, high in spans:
        first = int(np.searchsorted(end, low, "right"))
        last = int(np.searchsorted(start, high, "left"))
        mask[first:last] = True
        for a, b in zip(np.maximum(start[first:last], low).tolist(), np.minimum(end[first:last], high).tolist()):
            if a >= b:
                continue
            # several tokens may share one character
            if covered and a <= covered[-1][1] and covered[-1][0] >= low:
                covered[-1][1] = max(covered[-1][1], b)
            else:
                covered.append([a, b])
    return mask, covered


@lru_cache(2)
def _tokenizer(path):
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, END, LINE)])
    return tokenizer


def format_conversations(rows, key="conv_id", tokenizer=TOKENIZER, learned=LEARNED):
    """One row per conversation: key, formatted, ids, loss_mask, loss_spans, turns."""

    @F.arrow_udf(RESULT)
    def run(conversations: pa.Array) -> pa.Array:
        encode, out = _tokenizer(tokenizer), []
        for turns in conversations.to_pylist():
            formatted, spans = rendered([(t["role"], t["text"]) for t in turns])
            encoding = encode.encode(formatted, add_special_tokens=False)
            asked = [span for span, t in zip(spans, turns) if t["role"] in learned]
            mask, covered = masked(encoding.offsets, asked)
            out.append(
                {
                    "formatted": formatted,
                    "ids": encoding.ids,
                    "loss_mask": mask.tolist(),
                    "loss_spans": [{"start": a, "end": b} for a, b in covered],
                    "turns": [{"start": a, "end": b} for a, b in spans],
                }
            )
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kind = pa.struct(
            [
                ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())),
                ("loss_spans", span), ("turns", span),
            ]
        )
        return pa.array(out, kind)

    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    whole = rows.select(F.col(key).alias("_key"), "turn", "role", "text").groupBy("_key").agg(turns.alias("_turns"))
    done = whole.select(F.col("_key").alias(key), run("_turns").alias("_done"))
    return done.select(key, "_done.*")


def read_back(formatted="formatted"):
    """Column: the turns (role, text) of a formatted text, unescaped."""
    pattern = r"(?s)<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n"
    roles, texts = (F.regexp_extract_all(formatted, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(
        roles, texts,
        lambda r, t: F.struct(unescaped(F.replace(r, F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(t).alias("text")),
    )


def loss_text(formatted="formatted", spans="loss_spans"):
    """Column: all text under the loss mask, unescaped."""
    parts = F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))
    return F.array_join(parts, "")
