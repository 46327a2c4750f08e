"""Decision rules over collected figures. A lower log loss is better; a difference within ``BAND`` is noise."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

BAND = 0.002
#: Fixed values of single rules: folds to win, Brier tolerance, interactions that are many, agreement of reproduced figures.
FOLDS_TO_WIN, BRIER_TOLERANCE, MANY_INTERACTIONS, REPRODUCED = 4, 0.001, 30, 1e-4


def effect(rise: float, band: float = BAND) -> str:
    """Of a group, by the rise in loss without it."""
    return "helpful" if rise > band else "harmful" if rise < -band else "neutral"


def ablation_verdict(official: float, others: dict[str, float], band: float = BAND) -> dict:
    """Which ablations beat the official loss by more than noise; the official model is kept whatever they do."""
    return {"beats_official": sorted(n for n, loss in others.items() if loss < official - band), "keep": "official"}


def replacement(official_test: float, finalists: list[dict], band: float = BAND) -> dict | None:
    """The best finalist on test of those that beat the official loss by more than noise and were among the first three on validation, or use the official features.

    finalists: in validation order without the official one, each with test_log_loss and official_features.
    """
    fit = [f for rank, f in enumerate(finalists) if (rank < 3 or f.get("official_features")) and official_test - f["test_log_loss"] > band]
    return min(fit, key=lambda f: f["test_log_loss"]) if fit else None


def weight_class_verdict(keep: float, drop: float, zeroed_everywhere: bool, band: float = BAND) -> str:
    """Whether to drop the weight class, by mean validation losses with and without it."""
    return "robust_drop" if keep - drop > band else "zeroed_by_penalty" if zeroed_everywhere else "inconclusive"


def include_interactions(gain: float, folds_won: int, stable: Iterable[str], band: float = BAND) -> bool:
    return (gain > band or folds_won >= FOLDS_TO_WIN) and any(True for _ in stable)


@dataclass(frozen=True)
class Duel:
    """A model beside another, by their losses; a figure that either lacks decides nothing."""

    model: dict
    other: dict

    @property
    def same(self) -> bool:
        return self.model["name"] == self.other["name"]

    def lead(self, figure: str) -> float | None:
        """By how much the model's figure is lower."""
        own, theirs = self.model.get(figure), self.other.get(figure)
        return None if own is None or theirs is None else theirs - own

    def wins(self, figure: str, by: float) -> bool:
        lead = self.lead(figure)
        return lead is not None and lead > by

    def keeps_up(self, figure: str, slack: float = 0.0) -> bool:
        lead = self.lead(figure)
        return lead is None or lead >= -slack


#: What a candidate with interactions must show: in its duels with the official model and with the challenger, given the noise band.
INTERACTION_RULES: dict[str, Callable[[Duel, Duel, float], bool]] = {
    "beats_official": lambda official, _, band: official.wins("log_loss", band),
    "beats_or_is_challenger": lambda _, challenger, band: challenger.same or challenger.wins("log_loss", band) or challenger.model["folds_won"] >= FOLDS_TO_WIN,
    "test_consistent": lambda official, challenger, band: official.keeps_up("test_log_loss") and (challenger.same or challenger.keeps_up("test_log_loss", band)),
    "calibration_not_worse": lambda official, _, band: official.keeps_up("brier") and official.keeps_up("test_brier", BRIER_TOLERANCE),
    "not_too_complex": lambda _, challenger, band: challenger.model["nonzero_interactions"] <= MANY_INTERACTIONS or challenger.lead("log_loss") >= band,
    "not_fragile": lambda *_: True,  # decided by the study's stability figures, which gate the candidates
}


def interaction_criteria(selected: dict, official: dict, challenger: dict, leakage_ok: bool, band: float = BAND) -> dict:
    """Whether a candidate with interactions meets each of ``INTERACTION_RULES`` and leaks nothing; a replacement is never made here.

    Each model: name, log_loss and brier (validation), test_log_loss and test_brier (None if it was no finalist), and for the selected one
    folds_won (against the challenger) and nonzero_interactions.
    """
    duels = Duel(selected, official), Duel(selected, challenger)
    met = {name: rule(*duels, band) for name, rule in INTERACTION_RULES.items()} | {"leakage_ok": leakage_ok}
    passed, _ = conjunction(met)
    return {"criteria": met, "pass": passed, "replace_now": False}


def nonlinear_promotable(gain: float, folds_won: int, test_loss: float, anchor_test: float, leakage_ok: bool, band: float = BAND) -> bool:
    return gain > band and folds_won >= FOLDS_TO_WIN and test_loss <= anchor_test and leakage_ok


def blend_promotable(blend: float, linear: float, nonlinear: float, test_loss: float, anchor_test: float, leakage_ok: bool, band: float = BAND) -> bool:
    """A blend must beat both of its parts on validation by more than noise."""
    return min(linear, nonlinear) - blend > band and test_loss <= anchor_test and leakage_ok


def result_is_real(reproduced: dict[str, tuple[float, float]], bugs: dict[str, bool], beats_official: bool) -> bool:
    """A negative result stands if all known figures (expected, found) come out again, nothing is broken and no candidate wins on validation."""
    return all(abs(a - b) <= REPRODUCED for a, b in reproduced.values()) and not any(bugs.values()) and not beats_official


def conjunction(checks: dict[str, bool]) -> tuple[bool, list[str]]:
    """(all hold, those that do not): a rebuild's or a promotion's verdict."""
    failed = [n for n, ok in checks.items() if not ok]
    return not failed, failed


def listed(dated: list[tuple[str, str | None]], since: str | None, cap: int | None) -> list[str]:
    """Events of an audit: undated ones stay whatever the first day; the cap comes after the filter."""
    return [name for name, day in dated if since is None or day is None or day >= since][:cap]
