"""Job parameters and the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for results to match).
# ---------------------------------------------------------------------------
UNK_TOKEN = "<unk>"
BOS_TOKEN = "<|startoftext|>"
EOS_TOKEN = "<|endoftext|>"
UNK_ID = 0
BOS_ID = 1
EOS_ID = 2
PAD_ID = 0
IGNORE_INDEX = -100
# Encyclopedia assembly: infix between title and summary, minimum summary length,
# section titles that are skipped.
SUMMARY_INFIX = "的简介:"
MIN_SUMMARY_CHARS = 16
SKIPPED_SECTION_TITLES = ("全集在线观看", "截图")
# Encyclopedia pre-filter: keep rows whose content length is strictly above this.
MIN_CONTENT_CHARS = 50
# Article tail markers, in the order they are tested.
TAIL_MARKERS = ("References", "External links", "Charts")
# Characters removed from assembled encyclopedia text / mapped to a plain space.
DELETED_CHARS = "\x05�\x10\x08\x18"
SPACE_LIKE_CHARS = "\xa0　"
# Python's Unicode whitespace set written as a class valid in Java regex and RE2.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Pre-token pattern of the default vocabulary encoder: special tokens first, then
# letter runs, single digits, and any other single character.
PRETOKEN_PATTERN = r"<\|startoftext\|>|<\|endoftext\|>|<unk>|\p{L}+|\p{N}|[^\p{L}\p{N}]"
# Chat template pieces.
ROLE_SYSTEM = "system"
ROLE_USER = "user"
ROLE_ASSISTANT = "assistant"
# ---------------------------------------------------------------------------

SPECIAL_TOKENS = (UNK_TOKEN, BOS_TOKEN, EOS_TOKEN)


@dataclass(frozen=True)
class Params:
    """Defaults follow the reference configuration (length 1024, vocabulary 64000,
    eos id 2, test fraction 0.1 with seed 42, warm-up 0.06, beta 0.1,
    temperature 0.7, top_p 0.7, repetition penalty 1.2)."""

    max_length: int = 1024
    vocab_size: int = 64000
    eos_id: int = EOS_ID
    bos_id: int = BOS_ID
    pad_id: int = PAD_ID
    unk_id: int = UNK_ID
    ignore_index: int = IGNORE_INDEX
    group_rows: int = 1000          # rows per packing batch (library map default)
    code_language: str = "Python"   # value kept by the language filter
    test_fraction: float = 0.1
    seed: int = 42
    warmup_fraction: float = 0.06
    beta: float = 0.1
    temperature: float = 0.7
    top_p: float = 0.7
    repetition_penalty: float = 1.2
    batch_size: int = 24
    world_size: int = 2
    epochs: int = 3
    grad_accumulation: int = 1
    system_prompt: str = "You are a helpful assistant. Answer the user's questions."
    placeholder_values: tuple = field(default=(("<NAME>", "Helper"), ("<AUTHOR>", "the maintainers")))
    single_eos: bool = False
    dedup_compat: bool = False      # key without separators, as the reference builds it
    key_separator: str = "\x1f"
    broadcast_limit_rows: int = 2_000_000   # a larger vocabulary is refused, see tokens.bounded_broadcast

    def with_(self, **kw) -> "Params":
        from dataclasses import replace

        return replace(self, **kw)


DEFAULT = Params()
