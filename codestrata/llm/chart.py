"""Error-correcting chart parsing of short token sequences.

An Earley chart whose items carry the least number of edits so far.  Besides the usual steps
a token may be left out, an expected token put in, or one taken for another, for one edit each.
Items are worked off best first: by their own edits and the fewest that the tokens before and
behind them need, which the runs of tokens that occur in no sentence bound from below.
That is fast in long sequences with few edits.  In short ones, and where the search goes on, as in text of another language,
the whole chart is filled instead, shortest parts first and many parts at a time; both give the least number of edits.
"""

from __future__ import annotations

import numpy as np

#: Up to so many tokens the whole chart is filled before the search would have begun.
SHORT = 40


def _items_worth(n: int) -> int:
    """Items that the search works off in a fraction of the time in which the chart of ``n`` tokens is filled."""
    return 20 * n + n**3 // 512


class ChartGrammar:
    """Productions ``Name -> a B | c``; names that are defined are nonterminals, all else terminals."""

    def __init__(self, text: str):
        rules: list[tuple[str, tuple[str, ...]]] = []
        for line in text.strip().splitlines():
            if not line.strip():
                continue
            head, body = line.split("->", 1)
            alternatives: list[list[str]] = [[]]
            for symbol in body.split():
                if symbol == "|":
                    alternatives.append([])
                else:
                    alternatives[-1].append(symbol)
            rules.extend((head.strip(), tuple(a)) for a in alternatives)
        names = {h for h, _ in rules}
        self.start = {n: i for i, n in enumerate(sorted(names))}
        self.rules = [(self.start[h], tuple(self.start[s] if s in names else s for s in body)) for h, body in rules]
        self.filler: _Filler | None = None
        # items are numbered: one per dot position of each rule
        self.next: list[object] = []  # terminal (str), nonterminal (int) or None at the end
        self.head: list[int] = []
        self.by_head: list[list[int]] = [[] for _ in names]
        for h, body in rules:
            self.by_head[self.start[h]].append(len(self.next))
            for symbol in (*body, None):
                self.next.append(self.start[symbol] if symbol in names else symbol)
                self.head.append(self.start[h])
        self.closure = [self._predict(i) for i in range(len(names))]
        # items that stand before each symbol, for texts that begin anywhere
        self.before: dict[object, list[int]] = {}
        for item, symbol in enumerate(self.next):
            if symbol is not None:
                self.before.setdefault(symbol, []).append(item)

    def _predict(self, first: int) -> list[int]:
        """Items that a prediction of this nonterminal leads to, over any number of steps."""
        seen, todo, out = {first}, [first], []
        while todo:
            for item in self.by_head[todo.pop()]:
                out.append(item)
                s = self.next[item]
                if isinstance(s, int) and s not in seen:
                    seen.add(s)
                    todo.append(s)
        return out

    def error_at(self, tokens: list[str], start: str) -> int | None:
        """None if the tokens are a ``start``; else the number of the first token that fits no continuation."""
        nxt, head, closure = self.next, self.head, self.closure
        goal = self.start[start]
        n = len(tokens)
        waiting: list[dict[int, list[tuple[int, int]]]] = []
        current: set[tuple[int, int]] = {(i, 0) for i in closure[goal]}
        predicted = {goal}
        for at in range(n + 1):
            wants: dict[int, list[tuple[int, int]]] = {}
            todo = list(current)
            scanned: set[tuple[int, int]] = set()
            token = tokens[at] if at < n else None
            empty: set[int] = set()  # nonterminals already completed over nothing here
            complete = False
            if at:
                predicted = set()
            while todo:
                item, origin = todo.pop()
                s = nxt[item]
                if s is None:
                    h = head[item]
                    if origin == at:
                        if h in empty:
                            continue
                        empty.add(h)
                        parents = wants.get(h, ())
                    else:
                        parents = waiting[origin].get(h, ())
                    if at == n and h == goal and origin == 0:
                        complete = True
                    for p, po in list(parents):
                        e = (p + 1, po)
                        if e not in current:
                            current.add(e)
                            todo.append(e)
                elif isinstance(s, int):
                    wants.setdefault(s, []).append((item, origin))
                    if s not in predicted:
                        predicted.add(s)
                        for i in self.by_head[s]:
                            e = (i, at)
                            if e not in current:
                                current.add(e)
                                todo.append(e)
                    if s in empty:
                        e = (item + 1, origin)
                        if e not in current:
                            current.add(e)
                            todo.append(e)
                elif s == token:
                    scanned.add((item + 1, origin))
            waiting.append(wants)
            if at == n:
                return None if complete else n
            if not scanned:
                return at
            current = scanned
        return n

    def _run_end(self, tokens: list[str], begin: int) -> int | None:
        """End of the shortest run from ``begin`` that occurs inside of no sentence, None where all do.

        A run is read as a piece from the middle of a sentence: rules may have begun before it (origin -1), and
        when such a rule ends, any rule that has it may go on.
        """
        nxt, head, by_head, before = self.next, self.head, self.by_head, self.before
        at, n = begin + 1, len(tokens)
        current = {(i + 1, -1) for i in before.get(tokens[begin], ())}
        waiting: dict[int, dict[int, list[tuple[int, int]]]] = {}
        while current and at < n:
            token = tokens[at]
            wants: dict[int, list[tuple[int, int]]] = {}
            todo, scanned = list(current), set()
            predicted: set[int] = set()
            ended: set[int] = set()  # heads that ended here after beginning before the run
            empty: set[int] = set()
            while todo:
                item, origin = todo.pop()
                s = nxt[item]
                if s is None:
                    h = head[item]
                    if origin == -1:
                        if h in ended:
                            continue
                        ended.add(h)
                        grown = [(p + 1, -1) for p in before.get(h, ())]
                    elif origin == at:
                        if h in empty:
                            continue
                        empty.add(h)
                        grown = [(p + 1, o) for p, o in wants.get(h, ())]
                    else:
                        grown = [(p + 1, o) for p, o in waiting[origin].get(h, ())]
                elif isinstance(s, int):
                    wants.setdefault(s, []).append((item, origin))
                    grown = [(item + 1, origin)] if s in empty else []
                    if s not in predicted:
                        predicted.add(s)
                        grown.extend((i, at) for i in by_head[s])
                else:
                    if s == token:
                        scanned.add((item + 1, origin))
                    continue
                for e in grown:
                    if e not in current:
                        current.add(e)
                        todo.append(e)
            waiting[at] = wants
            current = scanned
            at += 1
        return None if current else at

    def damaged_runs(self, tokens: list[str], most: int) -> int:
        """Number of disjoint runs of tokens, at most ``most``, that occur inside of no sentence.

        Each of them takes an edit of its own, so this bounds the edits from below.
        """
        found, at = 0, 0
        while at < len(tokens) and found < most:
            end = self._run_end(tokens, at)
            if end is None:
                at += 1
            else:
                found, at = found + 1, end
        return found

    def _bounds(self, tokens: list[str]) -> tuple[list[int], list[int]]:
        """Fewest edits of ``tokens[:i]`` and of ``tokens[i:]`` for every i, by disjoint damaged runs."""
        n = len(tokens)
        ends = [self._run_end(tokens, b) for b in range(n)]
        behind, ahead = [0] * (n + 1), [0] * (n + 1)
        for b in range(n - 1, -1, -1):
            behind[b] = behind[b + 1] if ends[b] is None else max(behind[b + 1], 1 + behind[ends[b]])
        last: dict[int, int] = {e: b for b, e in enumerate(ends) if e is not None}  # the shortest run that ends there
        for e in range(1, n + 1):
            ahead[e] = max(ahead[e - 1], 1 + ahead[last[e]] if e in last else 0)
        return ahead, behind

    def repair(self, tokens: list[str], start: str, most: int | None = None) -> int:
        """Least number of edits that make the tokens a ``start``; with ``most``, ``most + 1`` where more are needed.

        ``start`` may name alternatives, as in ``A|B``, of which the cheapest counts.
        """
        if most is not None and self.damaged_runs(tokens, most + 1) > most:
            return most + 1
        starts = start.split("|")
        cost = None
        if len(tokens) > SHORT:
            bound = most
            for s in starts:
                cost = self._best_first(tokens, s, bound, _items_worth(len(tokens)))
                if cost is None:
                    break
                bound = cost - 1
        if cost is None:
            cost = self.fill(tokens, starts)
        return cost if most is None else min(cost, most + 1)

    def fill(self, tokens: list[str], starts: list[str]) -> int:
        """Least number of edits that make the tokens one of ``starts``, from the whole chart."""
        if self.filler is None:
            self.filler = _Filler(self.rules, len(self.start))
        return self.filler.edits(tokens, [self.start[s] for s in starts])

    def _best_first(self, tokens: list[str], start: str, most: int | None = None, items: int | None = None) -> int | None:
        """As :meth:`repair`; None once more than ``items`` items have been worked off."""
        n = len(tokens)
        nxt, head, by_head = self.next, self.head, self.by_head
        goal = self.start[start]
        ahead, behind = self._bounds(tokens)
        # best[at][(item, origin)]: least edits inside of the item's own part
        best: list[dict[tuple[int, int], int]] = [{} for _ in range(n + 1)]
        wants: list[dict[int, set[tuple[int, int]]]] = [{} for _ in range(n + 1)]
        ended: list[dict[int, dict[int, int]]] = [{} for _ in range(n + 1)]  # origin: head -> end -> edits
        levels: dict[int, list[tuple[int, int, int, int]]] = {}
        level, found = behind[0], None if most is None else most + 1

        def put(at: int, item: int, origin: int, cost: int) -> None:
            total = cost + ahead[origin] + behind[at]
            if found is None or total < found:
                here, key = best[at], (item, origin)
                old = here.get(key)
                if old is None or cost < old:
                    here[key] = cost
                    levels.setdefault(max(total, level), []).append((at, cost, item, origin))

        for i in by_head[goal]:
            put(0, i, 0, 0)
        while found is None or level < found:
            todo = levels.setdefault(level, [])
            while todo:
                at, cost, item, origin = todo.pop()
                if best[at][(item, origin)] != cost:
                    continue
                if items is not None:
                    items -= 1
                    if items < 0:
                        return None
                s = nxt[item]
                if s is None:
                    h = head[item]
                    ends = ended[origin].setdefault(h, {})
                    if cost < ends.get(at, cost + 1):
                        ends[at] = cost
                        # tokens after a complete part are left out
                        if h == goal and origin == 0 and (found is None or cost + n - at < found):
                            found = cost + n - at
                        outer = best[origin]
                        for p, po in list(wants[origin].get(h, ())):
                            put(at, p + 1, po, outer[(p, po)] + cost)
                elif isinstance(s, int):
                    if s in wants[at]:
                        wants[at][s].add((item, origin))
                    else:
                        wants[at][s] = {(item, origin)}
                        for i in by_head[s]:
                            put(at, i, at, 0)
                    for end, inner in list(ended[at].get(s, {}).items()):
                        put(end, item + 1, origin, cost + inner)
                else:
                    if at < n:
                        put(at + 1, item + 1, origin, cost + (tokens[at] != s))
                        put(at + 1, item, origin, cost + 1)
                    put(at, item + 1, origin, cost + 1)
            level += 1
        return found


class _Filler:
    """The whole chart at once: least edits of every part of the tokens as every symbol and every beginning of a rule.

    A row stands for a symbol or for the beginning of a rule, a diagonal for all parts of one length.  Tokens are left
    out before a token that is kept, or behind the last one.  What only puts tokens in leaves a part as it is; for that the
    distances between the symbols are worked out once for the grammar.
    """

    def __init__(self, rules: list[tuple[int, tuple]], n_symbols: int):
        self.n_symbols = n_symbols
        begun = {body[:k] for _, body in rules for k in range(1, len(body) + 1)}
        begun = sorted((b for b in begun if len(b) > 1 or isinstance(b[0], str)), key=lambda b: (len(b), repr(b)))
        row: dict[tuple, int] = {(a,): a for a in range(n_symbols)}
        row.update({b: n_symbols + i for i, b in enumerate(begun)})
        row[()] = self.n_rows = n_symbols + len(begun)  # the empty beginning comes last
        lengths = [len(b) for b in begun]
        self.levels = [(n_symbols + lengths.index(v), n_symbols + lengths.index(v) + lengths.count(v)) for v in sorted(set(lengths)) if v > 1]
        # of each beginning: the row without its last symbol, and the row of that symbol (of the empty beginning for a token)
        self.before, self.last = np.full(self.n_rows, self.n_rows), np.full(self.n_rows, self.n_rows)
        for b in begun:
            self.before[row[b]] = row[b[:-1]]
            if isinstance(b[-1], int):
                self.last[row[b]] = b[-1]
        inner = [b for b in begun if isinstance(b[-1], int)]
        self.inner = np.array([row[b] for b in inner], dtype=np.intp)
        ends = [b for b in begun if isinstance(b[-1], str)]
        self.ends = np.array([row[b] for b in ends], dtype=np.intp)
        codes = {t: i for i, t in enumerate(sorted({b[-1] for b in ends}))}
        self.codes, self.end_codes = codes, np.array([codes[b[-1]] for b in ends])
        whole = sorted({(h, row[body]) for h, body in rules if body and row[body] >= n_symbols})
        self.whole = np.array([r for _, r in whole], dtype=np.intp)
        heads = [h for h, _ in whole]
        self.heads = np.array(sorted(set(heads)), dtype=np.intp)
        self.head_starts = np.array([heads.index(h) for h in self.heads])
        # least tokens to put in for each row
        far = self.far = 1 << 14
        self.added = np.full(self.n_rows + 1, far)
        self.added[self.n_rows] = 0
        changed = True
        while changed:
            old = self.added.copy()
            for b in begun:
                self.added[row[b]] = self.added[row[b[:-1]]] + (self.added[b[-1]] if isinstance(b[-1], int) else 1)
            for h, body in rules:
                self.added[h] = min(self.added[h], self.added[row[body]])
            self.added = np.minimum(self.added, far)
            changed = bool((old != self.added).any())
        self.more = np.where(self.last < n_symbols, self.added[np.minimum(self.last, self.n_rows)], 1)
        # least tokens to put in around a part that is a symbol, to make it another row
        around = np.full((self.n_rows + 1, n_symbols), far)
        around[np.arange(n_symbols), np.arange(n_symbols)] = 0
        changed = True
        while changed:
            old = around.copy()
            for lo, hi in self.levels:
                q, x = self.before[lo:hi], self.last[lo:hi]
                around[lo:hi] = np.minimum(around[q] + self.more[lo:hi, None], around[x] + self.added[q][:, None])
            for h, body in rules:
                np.minimum(around[h], around[row[body]], out=around[h])
            np.minimum(around, far, out=around)
            changed = bool((old != around).any())
        self.around = around[:n_symbols]
        # the beginnings 1, 2, 4, ... symbols shorter and the tokens to put in from there; without any, the empty beginning
        step, put_in = np.append(self.before, self.n_rows), np.append(self.more, 0)
        step[:n_symbols], put_in[:n_symbols] = self.n_rows, 0
        self.jumps = []
        for _ in range(max(len(body) for _, body in rules).bit_length()):
            self.jumps.append((step, np.minimum(put_in, far)))
            step, put_in = step[step], put_in + put_in[step]
        self.of_kind: dict[int, tuple] = {}

    def edits(self, tokens: list[str], goals: list[int]) -> int:
        """Least number of edits that make the tokens one of the goals."""
        n, m = len(tokens), self.n_symbols
        known = self.added[self.added < self.far].max()
        # sums of two must fit, and nothing that can be reached may look as far as what cannot
        kind, far = next((k, f) for k, f in ((np.uint8, 127), (np.uint16, self.far), (np.uint32, 1 << 30)) if n + known < f)
        if far not in self.of_kind:
            tables = (self.added, self.around[:, self.heads], self.added[self.before], *(w for _, w in self.jumps))
            self.of_kind[far] = tuple(np.minimum(a, far).astype(kind)[..., None] for a in tables)
        added, around, added_before, *put_in = self.of_kind[far]
        jumps = [(step, w) for (step, _), w in zip(self.jumps, put_in)]

        def grow(cost: np.ndarray) -> None:
            for step, w in jumps:
                longer = cost.take(step, axis=0)
                longer += w
                np.minimum(cost, longer, out=cost)

        text = np.array([self.codes.get(t, -1) for t in tokens])
        other = (self.end_codes[:, None] != text[None, :]).astype(kind)
        before_end, before_inner, last_inner = self.before[self.ends], self.before[self.inner], self.last[self.inner]
        best = [int(self.added[g]) + n for g in goals]
        left: list[np.ndarray] = []  # by length: the beginnings that a symbol follows
        right: list[np.ndarray] = []  # by length: the symbols
        skipped = np.repeat(added, n + 1, axis=1)  # the rows with tokens left out behind them, of the length before
        for length in range(1, n + 1):
            width = n - length + 1
            cost = np.full((self.n_rows + 1, width), far, dtype=kind)
            cost[self.ends] = skipped[:, :width].take(before_end, axis=0) + other[:, length - 1 :]
            if length > 1:
                joined = np.full((len(self.inner), width), far, dtype=kind)
                for k in range(1, length):
                    both = right[length - k - 1][:, k : k + width].take(last_inner, axis=0)
                    both += left[k - 1][:, :width]
                    np.minimum(joined, both, out=joined)
                cost[self.inner] = joined
            grow(cost)
            if len(self.whole):
                own = np.minimum.reduceat(cost.take(self.whole, axis=0), self.head_starts, axis=0)
                np.minimum((own[None, :, :] + around).min(axis=1), far, out=cost[:m])
            last = cost.take(self.last, axis=0)
            last += added_before
            np.minimum(cost[: self.n_rows], last, out=cost[: self.n_rows])
            grow(cost)
            np.minimum(cost, far, out=cost)
            left.append(cost.take(before_inner, axis=0))
            right.append(cost[:m].copy())
            skipped = np.minimum(cost, skipped[:, :width] + kind(1))
            best.extend(int(cost[g, 0]) + n - length for g in goals)
        return min(best)
