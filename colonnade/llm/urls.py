"""URL filter: host and path rules, then a weighted vocabulary found by an Aho-Corasick automaton.

Terms count only between boundaries, which are the ends of the URL and all characters but a-z
and 0-9. One strict term, or ``soft_limit`` distinct soft terms, reject a URL. Rules come before the
vocabulary: of those that fit (their host or a subdomain, and a path that starts as theirs) the
longest wins, of equally long ones that with the longer host. Both lists are parameters that go to
every task, so they must fit its memory; URLs are judged one by one, without a shuffle.

Edge cases: a null URL, or one without ``://``, has an empty host and path, so that no rule fits; a
null is allowed; very long URLs are read whole; repeated rows are each judged; an empty table gives no row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ready

#: English, German, French and Spanish; a deployment names its own lists, or files of them (read_terms).
STRICT = tuple("""
adult bdsm blowjob camgirl camgirls camsex casino casinos cialis cumshot deepfakes erotik escort escorts fetish gangbang hardcore hentai incest keyloggers
levitra malware milf milfs naked nude nudes nudity onlyfans phishing porn porno pornos pornhub putas ransomware redtube sex sexe sexo sexshop sexy shemale
spyware striptease tramadol upskirt viagra voyeur warez xnxx xvideos xxx youporn
""".split())
SOFT = tuple("""
abnehmen ads affiliate affiliates apuesta apuestas baccarat bet bets betting bingo blackjack bonus bonos botox cash cheap clickbait click clics
coupon coupons crack cracked cracks credit credito crypto darlehen dating descuento diet dieta discount doubleclick escorte farm forex free freebie
gambling game-hack gewinn gewinnspiel giveaway gluecksspiel gratis gratuit guadagno hack hacks jackpot jeux kasino keto keygen keygens kredit kostenlos
leads loan loans loteria lotterie lottery loterie lotto mlm nackt payday pharmacie pharmacy pill pills pillen poker popads popunder pret prestamo prestamos
promo promocode rabatt rencontre rencontres replica replicas roulette sale serial serials slot slots spam spins sportsbook steroids surveys sweepstakes
tabletten tipster torrent torrents track tracker tracking treffen ultracheap vape wager warranty-free watches weightloss wett wetten win winner
""".split())


def read_terms(path: str) -> tuple[str, ...]:
    """The terms of a file, one a line, in lower case; empty lines and those that begin with # don't count."""
    with open(path, encoding="utf-8") as f:
        lines = [x.strip().translate(_LOWER) for x in f]
    return tuple(dict.fromkeys(x for x in lines if x and x[0] != "#"))


_LOWER = {i: i + 32 for i in range(65, 91)}
_HOST = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    m = _HOST.match(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class UrlFilter:
    def __init__(self, rules=(), strict=STRICT, soft=SOFT, soft_limit: int = 2):
        import ahocorasick

        self.soft_limit = soft_limit
        self.by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host.translate(_LOWER), []).append((len(host) + len(path), path, host + path, verdict))
        for own in self.by_host.values():
            own.sort(reverse=True)
        self.terms = ahocorasick.Automaton()
        for weight, terms in ((False, soft), (True, strict)):
            for term in terms:
                self.terms.add_word(term, (term, weight))
        self.terms.make_automaton() if len(self.terms) else None

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, int, str, str] | None = None
        at = 0
        while host and at >= 0:
            for size, start, name, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start):
                    if best is None or (size, len(host) - at) > best[:2]:
                        best = (size, len(host) - at, name, verdict)
                    break
            at = host.find(".", at) + 1 or -1
        return best[2:] if best else (None, None)

    def hits(self, url: str) -> tuple[list[str], list[str]]:
        """Distinct strict and soft terms between boundaries, sorted."""
        low = url.translate(_LOWER)
        found: tuple[set[str], set[str]] = (set(), set())
        if len(self.terms):
            inner = lambda c: "a" <= c <= "z" or "0" <= c <= "9"
            for end, (term, strict) in self.terms.iter(low):
                start = end - len(term) + 1
                if not (start and inner(low[start - 1])) and not (end + 1 < len(low) and inner(low[end + 1])):
                    found[not strict].add(term)
        return sorted(found[0]), sorted(found[1])


def judge(pages: DataFrame, rules=(), strict=STRICT, soft=SOFT, soft_limit: int = 2, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and the strict and soft terms of each URL."""
    ready(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        judge = UrlFilter(rules, strict, soft, soft_limit)
        for batch in batches:
            out = [[] for _ in range(6)]
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule, verdict = judge.rule(host, path)
                hard, light = judge.hits(url or "")
                if verdict is None:
                    verdict = "block" if hard or len(light) >= soft_limit else "allow"
                for column, x in zip(out, (host, path, rule, verdict, hard, light)):
                    column.append(x)
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.string(), lists, lists)))], names=["page_id", "host", "path", "rule", "verdict", "strict", "soft"])

    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, strict array<string>, soft array<string>")


def oracle(rules, strict=STRICT, soft=SOFT, soft_limit: int = 2) -> str:
    """DuckDB SQL of page_id, host, path, rule, verdict."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = lambda x: f"translate({x}, '{upper}', '{lower}')"
    order = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1])))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in order) + " end"
    verdict = "case rule " + " ".join(f"when '{h}{p}' then '{v}'" for v, h, p in order) + " else own end"
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    soft_n = " + ".join(f"{hit(t)}::int" for t in soft)
    own = f"case when {' or '.join(map(hit, strict))} or {soft_n} >= {soft_limit} then 'block' else 'allow' end"
    return f"""
with cut as (
  select page_id, {low("coalesce(url, '')")} as low,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, low, {low("regexp_extract(rest, '^[^/?#]*')")} as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
judged as (select page_id, host, path, {rule} as rule, {own} as own from parts)
select page_id, host, path, rule, {verdict} as verdict from judged"""
