"""A suffix automaton held in memory: the exact cross-parse that the distributed one is held against."""

BREAK = -1


class SuffixAutomaton:
    """Of texts over hashable symbols; a break symbol keeps matches within one text."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def add(self, words: list) -> None:
        for word in words:
            self._extend(word)
        self._extend(BREAK)

    def _extend(self, symbol) -> None:
        nxt, link, length = self.next, self.link, self.length
        p, cur = self.last, len(nxt)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def phrases(self, words: list) -> int:
        at = count = 0
        while at < len(words):
            state, to = 0, at
            while to < len(words) and words[to] in self.next[state]:
                state, to = self.next[state][words[to]], to + 1
            at = max(to, at + 1)
            count += 1
        return count
