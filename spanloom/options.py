"""Options of a transcription run, validated when made."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace
from typing import Any

from .operators.cues import CueLimits
from .operators.intervals import SAMPLE_RATE, Hysteresis
from .operators.state import contract_key

FORMATS = ("txt", "srt", "vtt", "json")
ASR_CONTRACT, RENDER_CONTRACT = 1, 1


class OptionError(ValueError):
    """An option, or two together, that can't be used."""


#: What an option's value has to be: a choice, or a kind of number.
CHOICES = {"vad": ("silero", "auditok", "none"), "alignment": ("word", "segment", "none"), "truncation_policy": ("retry", "warn"), "existing": ("error", "skip", "overwrite")}
KINDS = {
    "text_only vad_merge": ("true or false", lambda v: isinstance(v, bool)),
    "min_silence_ms speech_pad_ms batch_size max_new_tokens max_retry_tokens max_chars": ("a whole number", lambda v: isinstance(v, int) and not isinstance(v, bool)),
    "min_dur max_dur max_silence energy_threshold vad_threshold max_cue_dur max_gap": ("a finite number", lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)),
}
#: (mode that a rule holds in, what must hold there, what to say if it doesn't); options of other modes are left alone.
RULES = (
    ("always", lambda o: o.max_dur > 0, "max_dur is zero or less"),
    ("always", lambda o: o.batch_size >= 1, "batch_size is under 1"),
    ("always", lambda o: 1 <= o.max_new_tokens <= o.max_retry_tokens, "max_new_tokens is not from 1 to max_retry_tokens"),
    ("vad silero", lambda o: 0 <= o.vad_threshold <= 1, "vad_threshold is no probability"),
    ("vad silero", lambda o: o.min_silence_ms >= 0 and o.speech_pad_ms >= 0, "min_silence_ms or speech_pad_ms is negative"),
    ("vad silero", lambda o: 0 <= o.min_dur <= o.max_dur, "min_dur is not from 0 to max_dur"),
    ("vad auditok", lambda o: 0 < o.min_dur <= o.max_dur, "min_dur is not over 0 and up to max_dur"),
    ("vad auditok", lambda o: 0 <= o.max_silence < o.max_dur, "max_silence is not from 0 to below max_dur"),
    ("vad auditok", lambda o: o.energy_threshold >= 0, "energy_threshold is negative"),
    ("vad auditok", lambda o: not o.vad_merge, "vad_merge is for vad silero"),
    ("vad none", lambda o: o.max_dur >= 1, "windows without vad last a second at least"),
    ("vad none", lambda o: not o.vad_merge, "vad_merge is for vad silero"),
    ("cues", lambda o: o.max_chars > 0 and o.max_cue_dur > 0, "max_chars or max_cue_dur is zero or less"),
    ("cues", lambda o: o.max_gap >= 0, "max_gap is negative"),
    ("plain text", lambda o: o.formats == ("txt",), "a run without timing writes txt alone"),
)


@dataclass(frozen=True)
class Options:
    """What a run does.  Options of an inactive mode aren't refused, but every threshold must be finite."""

    language: str = "ar"
    model: str = "stub"
    model_revision: str | None = None
    text_only: bool = False
    vad: str = "silero"
    vad_engine: str = "auto"
    vad_merge: bool = False
    min_dur: float = 0.5
    max_dur: float = 30.0
    max_silence: float = 0.6
    energy_threshold: float = 50.0
    vad_threshold: float = 0.5
    min_silence_ms: int = 300
    speech_pad_ms: int = 60
    batch_size: int = 24
    max_new_tokens: int = 445
    max_retry_tokens: int = 896
    truncation_policy: str = "retry"
    alignment: str = "segment"
    max_chars: int = 80
    max_cue_dur: float = 6.0
    max_gap: float = 0.6
    formats: tuple[str, ...] | None = None
    existing: str = "error"

    def __post_init__(self) -> None:
        faults = [f"{name} is none of {', '.join(some)}" for name, some in CHOICES.items() if getattr(self, name) not in some]
        faults += [f"{name} is not {what}" for names, (what, fits) in KINDS.items() for name in names.split() if not fits(getattr(self, name))]
        if self.text_only and self.alignment == "word":
            faults.append("text_only leaves no words to align")
        self._raise(faults)
        if self.text_only:
            object.__setattr__(self, "alignment", "none")
        plain = self.alignment == "none"
        formats = self.formats if self.formats is not None else FORMATS[: 1 if plain else 3]
        object.__setattr__(self, "formats", tuple(dict.fromkeys(formats)))
        faults = [f"there is no format {f}" for f in sorted(set(self.formats) - set(FORMATS))] + ([] if self.formats else ["no format is given"])
        modes = {"always", f"vad {self.vad}", "plain text" if plain else "cues"}
        self._raise(faults + [said for mode, holds, said in RULES if mode in modes and not holds(self)])

    @staticmethod
    def _raise(faults: list[str]) -> None:
        if faults:
            raise OptionError("; ".join(faults))

    def hysteresis(self) -> Hysteresis:
        ms = SAMPLE_RATE / 1000
        return Hysteresis(threshold=self.vad_threshold, min_speech=self.min_dur * SAMPLE_RATE, max_speech=self.max_dur * SAMPLE_RATE, min_silence=self.min_silence_ms * ms, pad=self.speech_pad_ms * ms)

    def cue_limits(self) -> CueLimits:
        return CueLimits(self.max_chars, self.max_cue_dur, self.max_gap)

    def asr_key(self) -> str:
        """The contract of recognised text: settings of other modes don't count."""
        silero, auditok = self.vad == "silero", self.vad == "auditok"
        used: dict[str, Any] = {k: getattr(self, k) for k in ("language", "model", "model_revision", "vad", "max_dur", "batch_size", "max_new_tokens", "max_retry_tokens", "truncation_policy")}
        used |= {k: getattr(self, k) if silero else None for k in ("vad_engine", "vad_merge", "vad_threshold", "min_silence_ms", "speech_pad_ms")}
        used |= {k: getattr(self, k) if auditok else None for k in ("max_silence", "energy_threshold")}
        used["min_dur"] = self.min_dur if self.vad != "none" else None
        return contract_key({"version": ASR_CONTRACT, "settings": used})

    def render_key(self) -> str:
        """The contract of what is rendered from recognised text."""
        return contract_key({"version": RENDER_CONTRACT, "settings": {"alignment": self.alignment, "formats": sorted(self.formats), "max_chars": self.max_chars, "max_cue_dur": self.max_cue_dur, "max_gap": self.max_gap}})

    def but(self, **changes: Any) -> Options:
        return replace(self, **changes)

    def settings(self) -> dict[str, Any]:
        return asdict(self)
