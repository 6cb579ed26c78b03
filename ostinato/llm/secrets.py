"""Secret scans: patterns, and the novelty of strings in a sensitive context against a primed compressor.

A compressor is primed with a dictionary of identifiers and with the code around a candidate. What the candidate adds
to the compressed size is its novelty: names and words are mostly repeats and add little, keys and passwords add
about as much as their entropy. Candidates stand shortly after a word such as key or credential; what follows a
reported one after a line break, dot or quote only is measured too, and a private key's PEM block up to its END line.
Every candidate of at least LEAST_BYTES characters is measured. Long words that the dictionary doesn't have are as new
as keys to that compressor; strings without a digit must therefore be novel to a second one too, whose adaptive letter
statistics are primed with prose.
"""

from __future__ import annotations

import hashlib
import lzma
import math
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, pairwise

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm.rows import map_rows
from ostinato.llm.storage import DOCUMENT_COLUMNS, read_table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The longest runs of hexadecimal digits, if they have 24 or more.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"(?:key|secret|token|passw|passphrase|pwd|auth|credential|bearer|private|signature|cookie)", re.IGNORECASE | re.ASCII)
#: One of these is in every text that SENSITIVE or ASSIGN matches, in lower case.
HINTS = ("key", "secret", "token", "passw", "passphrase", "pwd", "auth", "credential", "bearer", "private", "signature", "cookie")
#: Parameters of the novelty scan: code points of context, compressed bytes for each character and in all.
REACH, AROUND, LEAST_RATIO, LEAST_BYTES = 40, 200, 0.6, 9
#: The second compressor's bytes for each character of strings without a digit; the length from which characters are entropy coded.
WORD_RATIO, LONG = 0.68, 64
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_BYTES},}}")
#: What may lie between two parts of one secret: dots, quotes and line breaks, the latter with indentation or a mark of quotation.
GAP = re.compile(r"""(?:[.'"]|\\[nr]|[\x20\t]*+[,+\\]?+[\x20\t]*+[\r\n]++[\x20\t]*+(?:[>\#*][\x20\t]++)?+)++""")
PEM_MARK = re.compile(r"-----(BEGIN|END) (?:[A-Z0-9]+ ){0,4}?PRIVATE KEY(?: BLOCK)?-----")
#: The base64 runs of a PEM block's body; headers and written line breaks aren't any.
PEM_RUN = re.compile(r"\\[nr]|^[A-Za-z-]+:.*$|([A-Za-z0-9+/=]+)", re.MULTILINE)
DIGITS = re.compile(r"[0-9]")
#: The part of a word before a place in it.
BEGUN = re.compile(r"[A-Za-z]*\Z")

IDENTIFIERS = """
self this return import from class def function const let var public private static void int string bool boolean float
double char long byte unsigned struct enum interface implements extends super new delete null None true false True False
if else elif for while do switch case break continue try except catch finally throw raise with as in is not and or lambda
yield async await print printf println format append extend insert remove update get set put post request response session
client server host port user username password passwd secret token api_key apikey access_key private_key public_key
credential credentials authorization Authorization Bearer Basic bearer auth signature cookie header headers content type
Content-Type application/json config settings environment environ getenv export path file name value values index length size
count result results data database table column query select insert where order group http https localhost example.com
aws_access_key_id aws_secret_access_key client_id client_secret refresh_token access_token id_token session_id csrf_token
BEGIN PRIVATE KEY END CERTIFICATE ssh-rsa encryption decrypt encrypt hash digest salt nonce uuid timestamp version
"""

#: Long words of prose.
PROSE = """
the of and to in that with for was are this from have which their would about there other into more than when been because
international national organisation organization organisational responsible responsibility possible possibility administration
administrative information informative communication education application association operation operational generation regulation
population situation production protection introduction construction collection connection direction election function section
instruction description subscription transaction interaction condition tradition addition position composition definition decision
commission permission expression impression discussion understanding government management agreement disagreement development
environment department statement investment requirement document treatment movement argument employment establishment announcement
important importance difference different experience conference reference evidence audience influence independent independence
university community security authority authorities authentication authenticated authorization authorisation identity activity
quality ability available availability reliability liability capability technology technological psychological history
historical political economic economical scientific electronic traditional professional individual additional personal original
particular particularly especially immediately approximately unfortunately certainly generally recently usually actually completely
following something everything everyone everybody sometimes somewhere however therefore together throughout although whatever
themselves ourselves yourself children business interesting interested including according considered considerable beautiful
successful wonderful meaningful knowledge language character literature temperature agriculture structure infrastructure
manufacturer signature signatures certificate certificates secretary secretariat privately privacy tokenization keyboard
remember september october november december january february american european british christian wednesday thursday saturday
question questions answer answered example examples problem problems programme program company companies customers customer
passwordless passphrases credentials encrypted decrypted encryption decryption algorithm configuration documentation implementation
initialization directory repository variables parameter parameters arguments response request endpoint database
gouvernement développement investissement particulièrement notamment également seulement aujourd'hui toujours
connaissance naissance puissance différence expérience société université communauté sécurité qualité activité
entreprise entreprises politique économique historique électronique nationale internationale personnes personne première premier
maintenant pendant plusieurs beaucoup quelque quelques lorsque notre votre leurs cette avec dans pour sur sont être avoir
Zusammenarbeit Zusammenhang Geschwindigkeit Möglichkeit Schwierigkeit Wirklichkeit Gesellschaft Wirtschaft Wissenschaft Mannschaft
Regierung Entwicklung Verwaltung Bedeutung Ausbildung Verbindung Veröffentlichung Beschreibung Verschlüsselung Versicherung
wissenschaftlich wirtschaftlich gesellschaftlich natürlich möglich wahrscheinlich verschiedene verschiedenen unterschiedlich
zwischen während werden worden wurden andere anderen einige einigen können müssen sollen nicht auch eine einer eines durch gegen
unter über nach beim aber oder sich sind haben hatte geworden Deutschland deutschen Schlüssel Passwort Zugang
gobierno desarrollo investigación investigacion administración organización información educación comunicación producción situación
conocimiento movimiento crecimiento establecimiento importancia diferencia experiencia sociedad universidad comunidad seguridad
calidad actividad empresa empresas política económica histórica nacional internacional personas persona primero primera
principalmente especialmente actualmente también siempre entonces mientras durante aunque porque cuando donde sobre entre desde hasta
ABCDEFGHIJKLMNOPQRSTUVWXYZ INTERNATIONAL ORGANIZATION INFORMATION AUTHORIZATION AUTHENTICATION CERTIFICATE DOCUMENTATION CONFIGURATION
-----BEGIN RSA PRIVATE KEY----- -----END OPENSSH ENCRYPTED EC DSA PUBLIC ======== --------
acknowledgement advertisement anniversary appreciated architecture arrangements assassination astonishing bankruptcy
battlefield breakthrough broadcasting catastrophe celebration championship chronological circumstances civilization
coincidence collaboration commissioner comprehensive concentrated congratulations consciousness consequences conservation
consideration constituency contemporary controversial conversation correspondent counterpart craftsmanship demonstration
determination disappointed disciplinary distinguished embarrassing encouragement enlightenment entertainment enthusiastic
extraordinary flexibility frustration fundamental grandmother handwriting headquarters hypothetical illustration imagination
implications independently inheritance installation intellectual intelligence interpretation intervention jurisdiction
kilometres legislation lighthouse locksmith locksmiths maintenance mathematics measurements misunderstanding neighbourhood
nevertheless observation occasionally opportunities orchestra parliamentary partnership perspective philosophical photograph
preliminary presentation prestigious professor psychology questionnaire recommendation refrigerator relationship renaissance
representative revolutionary satisfaction schoolteacher settlement significantly sophisticated spokesperson straightforward
strengthening substantial superintendent surrounding sustainable sympathetic thunderstorm transformation transportation
tremendous unbelievable undergraduate unemployment unprecedented vegetables vocabulary vulnerability warehouse wilderness
workshop appartement bibliothèque changement chercheurs conséquence construire enseignement environnement fonctionnaires
habitants magnifique naturellement professeur quotidienne recherche renseignements traditionnel Arbeitsplatz Aufmerksamkeit
Bundesregierung Bürgermeister Einrichtung Fahrrad Forschung Gemeinschaft Gesundheit Krankenhaus Landwirtschaft Mitarbeiter
Nachrichten Staatsanwaltschaft Straßenbahn Unternehmen Verantwortung Wohnungen ayuntamiento biblioteca ciudadanos compañeros
construcción enfermedad estadounidense extranjero funcionamiento medioambiente naturaleza presidente profesores trabajadores
authoritative reauthorisation authorship keyholders secretarial signatories cookiecutter privateer
1234567890 0123456789 abcdefghijklmnopqrstuvwxyz
"""
MONTHS = " ".join(f"{year}-{month:02d}" for year in range(2000, 2036) for month in range(1, 13))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, leftmost and without overlap in each kind; kinds count as in KINDS."""
    found = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def apart(taken: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether a span overlaps none of ``taken``, which is sorted."""
    starts, furthest = [a for a, _, _ in taken], list(accumulate((b for _, _, b in taken), max))

    def free(start: int, end: int) -> bool:
        earlier = bisect_left(starts, end)
        return not earlier or furthest[earlier - 1] <= start

    return free


ADAPTIVE = [{"id": lzma.FILTER_LZMA2, "lc": 4, "lp": 0, "pb": 0, "dict_size": 1 << 16, "mode": lzma.MODE_NORMAL, "nice_len": 64, "mf": lzma.MF_BT2, "depth": 64}]


class Novelty:
    """Marginal compressed bytes of a string within its surroundings."""

    def __init__(self, identifiers: str = MONTHS + PROSE + IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.prose = (identifiers + " ").encode()
        self.words = lru_cache(1 << 14)(lambda word: self.adaptive(self.prose + word.encode()) - self.adaptive(self.prose))
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def adaptive(self, data: bytes) -> int:
        return len(lzma.compress(data, lzma.FORMAT_RAW, filters=ADAPTIVE))

    def marginal(self, before: str, candidate: str, after: str) -> int:
        without = len(self.compressor.compress((before + after).encode("utf-8", "surrogatepass")))
        return len(self.compressor.compress((before + after + candidate).encode("utf-8", "surrogatepass"))) - without

    def novel(self, text: str, start: int, end: int) -> bool:
        added = self.marginal(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND])
        share = math.log2(len(set(text[start:end]))) / 6 if end - start >= LONG else 1
        if added < max(LEAST_BYTES, LEAST_RATIO * min(1, share) * (end - start)):
            return False
        if end - start >= LONG or DIGITS.search(text, start, end):
            return True
        # A sensitive word may be the head of a longer one, as in authoritative: that is measured whole.
        word = BEGUN.search(text[max(0, start - AROUND) : start])[0] + text[start:end]
        return self.words(word) >= WORD_RATIO * len(word)

    def pem_spans(self, text: str) -> list[tuple[int, int, int]]:
        """All runs between the BEGIN and the END line of a private key of which some run is novel."""
        found, marks = [], list(PEM_MARK.finditer(text)) if "PRIVATE KEY" in text else []
        for begin, end in pairwise(marks):
            if (begin[1], end[1]) == ("BEGIN", "END"):
                runs = [m.span(1) for m in PEM_RUN.finditer(text, begin.end(), end.start()) if m[1]]
                if any(b - a >= LEAST_BYTES and self.novel(text, a, b) for a, b in runs):
                    found += [(a, 3, b) for a, b in runs]
        return found

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of novel strings that overlap none of ``taken``, which is sorted."""
        low, found, seen = text.lower(), [], 0
        if not any(x in low for x in HINTS):
            return found
        free = apart(taken)
        found = [x for x in self.pem_spans(text) if free(x[0], x[2])]
        free = apart(sorted(taken + found))
        for word in SENSITIVE.finditer(text):
            last = word.end() + REACH
            at = max(word.end(), seen)
            # A candidate begins within reach and is read to its end, once; only its first characters are looked for.
            while at <= last and (near := CANDIDATE.search(text, at, last + LEAST_BYTES)):
                whole = CANDIDATE.match(text, near.start())
                start, end = whole.span()
                at = seen = end
                if free(start, end):
                    if not self.novel(text, start, end):
                        continue
                    found.append((start, 3, end))
                # The next part of what was reported is within reach wherever it begins.
                if gap := GAP.match(text, end):
                    last = max(last, gap.end())
        return found

    def all_spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = base_spans(text)
        return base, sorted(base + self.spans(text, base))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per span: doc_id, kind, start and end (code points, end exclusive), and the string itself.

    Null texts count as empty and give no rows; repeated rows give repeated spans; other columns aren't read.
    """

    def step():
        novelty = Novelty()

        def call(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": [], "kind": [], "start": [], "end": [], "value": []}
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for a, k, b in novelty.all_spans(text or "")[1]:
                    for name, value in zip(out, (doc_id, KINDS[k], a, b, text[a:b]), strict=True):
                        out[name].append(value)
            return out

        return call

    return map_rows(docs.select("doc_id", "text"), step, "doc_id long, kind string, start long, end long, value string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span (overlapping ones together) replaced by a mark and n_chars counted anew.

    No document goes; those without secrets are as they were.
    """

    def step():
        novelty = Novelty()

        def clean(text: str | None, n_chars: int | None) -> tuple[str | None, int | None]:
            spans = novelty.all_spans(text or "")[1]
            if not spans:
                return text, n_chars
            parts, at = [], 0
            for a, _, b in spans:
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            made = "".join(parts) + text[at:]
            return made, len(made)

        def call(batch: dict[str, list]) -> dict[str, list]:
            made = [clean(t, n) for t, n in zip(batch["text"], batch["n_chars"], strict=True)]
            return batch | {"text": [m[0] for m in made], "n_chars": [m[1] for m in made]}

        return call

    rows = docs.select(*DOCUMENT_COLUMNS)
    return map_rows(rows, step, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in each document."""

    def step():
        novelty = Novelty()

        def call(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "n_novel": [], "base_sha256": [], "spans": []}
            for text in batch["text"]:
                base, every = novelty.all_spans(text or "")
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"].append(sum(s[1] == k for s in every))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(every))
            return out

        return call

    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return map_rows(docs, step, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
