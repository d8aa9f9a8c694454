"""Parameters and fixed values.

The values in the block marked FIXED VALUES must stay equal to the
behaviour being rebuilt (pattern lists, word lists, prompt texts,
thresholds).  They are written out plainly, in their natural order.
Everything else is a typed parameter with a default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES
# ---------------------------------------------------------------------------

# Topic keyword patterns (calculus), applied case-insensitively to the
# lowercased problem; any match marks the row as on-topic.
TOPIC_PATTERNS: tuple[str, ...] = (
    # limits
    r"\blimit\b", r"\blim\b", r"\\lim", r"approaches", r"tends to",
    # derivatives
    r"\bderivative\b", r"\bdifferentiate\b", r"\bdifferentiation\b",
    r"f'\(", r"f''", r"dy/dx", r"d/dx", r"\\frac\{d", r"\\partial",
    # integrals ("integral number/part/value" means a whole number)
    r"\bintegral\b(?!\s+(?:number|part|value))", r"\bintegrate\b", r"\bintegration\b",
    r"\\int", r"antiderivative", r"primitive",
    # series
    r"convergent", r"divergent",
    r"taylor", r"maclaurin", r"\\sum.*n=",
    # differential equations
    r"differential equation", r"\bODE\b", r"\bPDE\b",
    # continuity (with maths context)
    r"\bcontinuous\b(?=\s*(?:\(|function|at|on|over|from|if|and\s+differentiable))",
    r"\bcontinuity\b", r"discontinuous",
    # function analysis
    r"critical point", r"inflection", r"concav", r"extrema",
    r"maximum.*function", r"minimum.*function", r"monoton",
    r"increasing.*function", r"decreasing.*function",
    # other terms
    r"rate of change", r"instantaneous", r"tangent line",
    r"area under", r"volume of revolution", r"l'h[oô]pital",
)

# Low-quality patterns, searched case-insensitively in the rendered example.
LOW_QUALITY_PATTERNS: tuple[str, ...] = (
    r"```",                 # code fence
    r"===+|---+",           # ASCII rules
    r"\[image.*\]",         # image reference
    r"Figure\s*\d+",        # figure reference
    r"Question\s*\d+\s*:",  # question numbering
    r"\.\s*\.\s*\.",        # dotted ellipsis
    r"\\frac\s*\d",         # \frac followed by a bare digit
)

# Words whose presence (as substrings of the lowercased think text) marks
# "good thinking".
GOOD_THINKING_MARKERS: tuple[str, ...] = (
    "step", "→", "=>", "first", "therefore", "so", "then", "hence",
)

# Marker words counted as whole words, case-sensitive.
MARKER_WORDS: tuple[str, ...] = ("Wait", "Alternatively", "But")

# Words whose token sequences may be masked in SFT labels (first listed
# word wins on overlap; "Then" appears twice in the original list).
MASK_WORDS: tuple[str, ...] = (
    "Wait", "Alternatively", "But", "First", "Second", "Third", "first", "second",
    "third", "Then", "So", "Therefore", "Similarly", "Let", "Now", "Then",
)
MASK_RATIO = 0.30

# Default system message of the chat template and its boxed instruction.
SYSTEM_PROMPT = (
    "You are a helpful and harmless assistant. "
    "You are Qwen developed by Alibaba. "
    "You are an expert in calculus (limits, derivatives, integrals, differential equations). "
)
BOXED_INSTRUCTION = (
    "Please reason step by step, and put your final answer within \\boxed{}. "
    "The \\boxed{} should contain ONLY the final answer (number, expression, or value) "
    "without any explanation or units unless the problem specifically asks for it."
)

# Topic classifier request texts.
TOPIC_SYSTEM_PROMPT = """You are Qwen, created by Alibaba Cloud. You are a helpful assistant. You are a math topic classifier. Your task is to determine if a math problem belongs to CALCULUS.

Calculus topics include:
- Limits
- Derivatives and differentiation
- Integrals and integration
- Differential equations
- Continuity
- Function analysis: extrema, monotonicity, concavity, inflection points

NOT calculus:
- Basic algebra, equations, inequalities
- Geometry (without calculus methods)
- Combinatorics, probability (without limits/integrals)
- Number theory
- Linear algebra (matrices, vectors without calculus)

Answer with ONLY one word: "CALCULUS" or "OTHER"
"""
TOPIC_USER_PROMPT = "Classify this problem:\n\n{problem}"
TOPIC_WORD = "CALCULUS"

# Answer-equivalence prompt template with its three slots.
EQUIVALENCE_PROMPT = """You are a mathematical reasoning engine specialized in checking equivalence of symbolic expressions.

Your task: Given a problem and two answers (already extracted from boxed expressions), determine whether Answer 1 and Answer 2 represent the SAME mathematical expression.

Rules:
- Treat expressions as equivalent even if written in different but algebraically equal forms.  
  (e.g., (x+5)/6 is equivalent to (1/6)x + 5/6.)
- Ignore cosmetic differences (spacing, parentheses, formatting).
- Consider simplification, inverse operations, algebraic manipulation, and standard mathematical identities.
- If they are equivalent → output exactly:  \\boxed{TRUE}
- If they are not equivalent → output exactly: \\boxed{FALSE}
- Do NOT provide explanation.
- Output ONLY the boxed TRUE/FALSE.

Problem:
""{instruction}""

Answer 1:
""{ans1}""

Answer 2:
""{ans2}""

"""
EQUIVALENCE_SLOTS = ('""{instruction}""', '""{ans1}""', '""{ans2}""')

# Difficulty buckets by token length: < 700 easy, < 1400 medium, else hard.
EASY_BELOW = 700
MEDIUM_BELOW = 1400

# Split ratios, shuffle seeds, evaluation batch size.
VAL_RATIO = 0.017
TEST_RATIO = 0.032
SHUFFLE_SEED = 3407
TEST_SHUFFLE_SEED = 42
EVAL_BATCH_SIZE = 10
LENGTH_POWER = 0.7
HISTOGRAM_BINS = 50
LOSS_HISTOGRAM_BINS = 1000
IGNORE_INDEX = -100
GOLD_SIGNAL = "#### "
NOT_FOUND_TEXT = "Không tìm thấy"

# Reward defaults (active weights: format 1.0, cosine on marker words 2.0,
# repetition 0.1).
REWARD_WEIGHTS = {"format": 1.0, "cosine_markers": 2.0, "repetition": 0.1}
COSINE_MIN_VALUE_WRONG = 0.0
COSINE_MAX_VALUE_WRONG = -0.5
COSINE_MIN_VALUE_CORRECT = 0.5
COSINE_MAX_VALUE_CORRECT = 1.0
COSINE_MAX_LEN = 12000
COSINE_MAX_WORD = 15
REPETITION_NGRAM = 3
REPETITION_MAX_PENALTY = -0.5
# Script flag: LaTeX spans and commands that are removed first, and the ranges of
# Cyrillic, CJK, Arabic, Hebrew, Thai and Greek characters that are flagged.
LATEX_SPAN = r"(?s)\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]|\\begin\{.*?\}.*?\\end\{.*?\}"
LATEX_COMMAND = r"\\[a-zA-Z]+(?:\{[^{}]*\}|\[[^\[\]]*\])*"
FLAGGED_SCRIPTS: tuple[tuple[int, int], ...] = (
    (0x0400, 0x04FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
    (0x0600, 0x06FF), (0x0590, 0x05FF), (0x0E00, 0x0E7F), (0x0370, 0x03FF),
)
# Answer commands: text and a choice letter in text.
TEXT_COMMAND = r"\\text\{([^}]*)\}"
TEXT_LETTER = r"\A\\text\{([A-Da-d])\}\z"
STEP_REWARD_PATTERN = r"(Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)"

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class CosineParams:
    min_value_wrong: float = COSINE_MIN_VALUE_WRONG
    max_value_wrong: float = COSINE_MAX_VALUE_WRONG
    min_value_correct: float = COSINE_MIN_VALUE_CORRECT
    max_value_correct: float = COSINE_MAX_VALUE_CORRECT
    max_len: int = COSINE_MAX_LEN
    max_word: int = COSINE_MAX_WORD


@dataclass(frozen=True)
class SourceSpec:
    """How one raw source maps to the curated schema (one ``curate_source`` call).

    Column names refer to the raw DataFrame.  ``answer_col == "</think>"``
    means the answer is the text after the first ``</think>`` of the think
    column.
    """

    name: str
    question_col: str
    answer_col: str
    think_col: str | None = None
    mask_col: str | None = None
    correct_col: str | None = None
    question_alt_col: str | None = None
    group_col: str | None = None
    row_id_col: str = "row_id"
    token_len_col: str | None = None
    keys_equal: tuple[tuple[str, object], ...] | None = None
    answer_signal: str | None = None
    data_type: str = "math"
    n_samples: int | None = None
    max_candidates: int | None = None
    max_data_samples: int | None = None
    min_token: int | None = None
    max_token: int | None = None
    length_sampling: bool = False
    length_power: float = LENGTH_POWER
    boxed_force: bool = True
    strip_answer_tags: tuple[str, ...] | None = None
    max_think_segment_chars: int | None = None
    max_per_group: int | None = None
    topic_only: bool = False
    seed: int = SHUFFLE_SEED
    system_prompt: str = SYSTEM_PROMPT
    topic_patterns: tuple[str, ...] = field(default=TOPIC_PATTERNS)
