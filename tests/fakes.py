"""A provider of analyst payloads for the tests, as data source options name it."""

from __future__ import annotations

import datetime as dt


class Flaky:
    """Each symbol gets its own number; B's targets fail once, C's always, E has other shapes."""

    def __init__(self, options: dict[str, str]):
        self.calls: dict[str, int] = {}
        self.scale = float(options.get("scale", 1))

    def symbols(self) -> list[str]:
        return ["A", "B", "C", "D", "E"]

    def quote(self, symbol: str) -> object:
        if symbol == "C":
            raise ConnectionError("no quote")
        return {"lastPrice": self.scale * (1 + ord(symbol) - ord("A"))}

    def targets(self, symbol: str) -> object:
        n = self.calls[symbol] = self.calls.get(symbol, 0) + 1
        if symbol == "C" or (symbol == "B" and n == 1):
            raise TimeoutError("slow")
        return {"current": 5, "lowPrice": "3", "mean": float("nan"), "median": True, "high": None} if symbol != "E" else [1, 2]

    def recommendations(self, symbol: str) -> object:
        return [{"period": "-1m", "strongBuy": 1}, {"Period": "0M", "strong_buy": 7, "strongSell": 2}] if symbol != "E" else "none"

    def eps_revisions(self, symbol: str) -> object:
        return {"+1q": {"upLast7days": 9}, " 0q": {"up_last_7_days": 4, "downLast30days": 1.5}} if symbol != "E" else None

    def earnings_dates(self, symbol: str) -> object:
        return [dt.datetime(2001, 12, 20, tzinfo=dt.UTC), "2001-12-01T03:00:00+05:30", dt.date(2002, 1, 1), "soon", None]


class Broken(Flaky):
    """Payloads that cannot be taken apart for one symbol."""

    def eps_revisions(self, symbol: str) -> object:
        class Odd(dict):
            def items(self):
                raise RuntimeError("odd")

        return {"0q": Odd()} if symbol == "D" else super().eps_revisions(symbol)
