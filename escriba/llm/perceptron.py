"""An averaged perceptron over sparse features, small enough to travel with a task."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterable, Sequence


class AveragedPerceptron:
    """Weights per feature; of several candidates the one with the highest sum wins."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self._totals: dict[str, float] = defaultdict(float)
        self._since: dict[str, int] = defaultdict(int)
        self._step = 0

    def score(self, features: Iterable[str]) -> float:
        weights = self.weights
        return sum(weights.get(f, 0.0) for f in features)

    def best(self, candidates: Sequence[Sequence[str]]) -> int:
        """Index of the best candidate, the first of equals."""
        scores = [self.score(c) for c in candidates]
        return max(range(len(scores)), key=lambda i: (scores[i], -i))

    def _move(self, feature: str, by: float) -> None:
        weight = self.weights.get(feature, 0.0)
        self._totals[feature] += (self._step - self._since[feature]) * weight
        self._since[feature] = self._step
        self.weights[feature] = weight + by

    def learn(self, candidates: Sequence[Sequence[str]], wanted: int) -> bool:
        """One step; True if the guess was right."""
        self._step += 1
        guess = self.best(candidates)
        if guess == wanted:
            return True
        for feature in candidates[wanted]:
            self._move(feature, 1.0)
        for feature in candidates[guess]:
            self._move(feature, -1.0)
        return False

    def fit(self, examples: list[tuple[Sequence[Sequence[str]], int]], rounds: int = 6, seed: int = 5) -> AveragedPerceptron:
        """Pass over the examples a few times in changing order, then average the weights over all steps."""
        rng = random.Random(seed)
        order = list(range(len(examples)))
        for _ in range(rounds):
            rng.shuffle(order)
            if all([self.learn(*examples[i]) for i in order]):
                break
        for feature in list(self.weights):
            total = self._totals[feature] + (self._step - self._since[feature]) * self.weights[feature]
            self.weights[feature] = total / max(1, self._step)
        self.weights = {f: w for f, w in self.weights.items() if abs(w) > 1e-9}
        self._totals.clear()
        self._since.clear()
        return self
