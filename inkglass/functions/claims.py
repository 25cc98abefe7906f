"""Claims: which paragraphs and sentences make one, of what kind, how grave."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkglass.functions import text as T

# The signals of each kind, in the order in which they count.
SIGNALS = [
    ("quotation", "“[^”]+”|\"[^\"]+\"|'[^']+'"),
    (
        "comparative",
        "(?iU)\\b(?:more than|less than|fewer than|greater than|higher than|lower than|compared to|in comparison|than the|outperform|underperform|exceeds?"
        "|surpasses?|daha yüksek|daha düşük|daha fazla|daha az|kıyasla|oranla|kıyaslandığında)\\b",
    ),
    (
        "causal",
        "(?iU)\\b(?:causes?|leads? to|results? in|due to|because of|contributes? to|is associated with|is linked to|correlates? with|affects?|influences?"
        "|neden ol[\\p{L}\\p{N}_]*|yol aç[\\p{L}\\p{N}_]*|nedeniyle|kaynaklan[\\p{L}\\p{N}_]*|etkile[\\p{L}\\p{N}_]*|ilişkilidir)\\b",
    ),
    (
        "statistic",
        "(?iU)%\\s*\\d[\\d,.]*|\\b\\d[\\d,.]*\\s*(?:%|percent|million|billion|trillion|thousand|hundred|milyon|milyar|bin)"
        "|\\b(?:approximately|roughly|about|nearly|over|around|up to|yaklaşık|en az|en çok|yüzde)\\s+\\d"
        "|\\b(?:increase|decrease|growth|rate|ratio|proportion|average|median|mean|artış|azalış|oran|ortalama)\\b.*\\d",
    ),
    (
        "prior_work",
        "(?iU)\\b(?:previous|prior|earlier|following|subsequent|existing|established)\\s+"
        "(?:work|study|research|studies|findings|evidence|literature|approach|method|technique|framework|model)",
    ),
    ("historical", "(?iU)\\b(?:first|introduced|discovered|established|founded|proposed|published|invented|developed|created|originated|began|emerged)\\b"),
    ("definition", "(?iU)\\b(?:is defined as|refers to|is known as|is called|can be defined|means that|is understood as|is characterized by)\\b"),
]
GENERAL = "general_fact"
# What keeps a paragraph from being a claim, and what negates. U: letters and case beyond ASCII count.
INSTRUCTION = "(?iU)^(?:#+\\s*)?(?:note|todo|fixme|hack|xxx|important|attention|warning|please|ensure|make sure|do not|never|always|must|should|shall)\\b"
DECISION = "(?iU)\\b(?:we (?:decided|chose|selected|opted|will use|plan to)|the (?:goal|purpose|aim) (?:of this|is to))\\b"
FORM_LABEL = (
    "(?iU)^(?:başvuru sahibinin adı soyadı|danışmanın adı soyadı|araştırma önerisinin başlığı|araştırmanın yürütüleceği kurum(?:/kuruluş)?|anahtar kelimeler)\\s*:"
)
FORM_CONTEXT = (
    "(?iU)(?:^|[^\\p{L}\\p{N}_])(?:başvuru formu(?:nun|nda|na)?|bu bölüm(?:ün|de|e)?|araştırma önerisi(?:nin|nde|ne)?|anahtar kelimeler|çalışma takvimi(?:nin|nde|ne)?"
    "|risk yönetimi tablosu(?:nun|nda|na)?|çizelge(?:deki|nin)?|satır(?:lar|ların)?|sütun(?:daki|lar|ların)?)(?:$|[^\\p{L}\\p{N}_])"
)
DIRECTIVE = (
    "(?iU)(?:^|[^\\p{L}\\p{N}_])(?:beklenir|önerilir|istenir|yazılmalı(?:dır)?|hazırlanmalı(?:dır)?|doldurulmalı(?:dır)?|açıklanmalı(?:dır)?|belirtilmeli(?:dir)?|sunulmalı(?:dır)?"
    "|gösterilmemeli(?:dir)?|ortaya konulur|ifade edilir|belirtilir|eklenebilir|yazılır|sunulur|verilir|özetlenir|doldurularak)(?:$|[^\\p{L}\\p{N}_])"
)
NEGATION = (
    "(?iU)\\b(?:not|no|did not|does not|failed to|no significant|not associated|not linked|no evidence|no effect|no impact|not significantly|not considerably"
    "|neither|nor|without|lack of|absence of|contrary to|opposite of|refutes?|negates?)\\b"
)
SEVERITY = {"statistic": "high", "causal": "high", "quotation": "high", "comparative": "medium", "historical": "medium", "definition": "medium"}
LEAST_PARAGRAPH, LEAST_SENTENCE = 5, 4  # words


def not_a_claim(paragraph: Column) -> Column:
    """Headings, notes, form labels, instructions, decisions, short paragraphs."""
    p = F.trim(paragraph)
    letters = F.regexp_replace(p, "[^\\p{L}]", "")
    shouted = (F.length(letters) >= 4) & (letters == F.upper(letters)) & (letters != F.lower(letters))
    return (
        (p == "") | p.startswith("#") | p.startswith("(*)") | p.startswith("(**)") | shouted | p.rlike(FORM_LABEL) | p.rlike(INSTRUCTION)
        | (p.rlike(FORM_CONTEXT) & p.rlike(DIRECTIVE)) | p.rlike(DECISION) | (F.size(T.tokens_by_space(p)) < LEAST_PARAGRAPH)
    )


def claim_type(sentence: Column) -> Column:
    out = F.lit(GENERAL)
    for kind, pattern in reversed(SIGNALS):
        out = F.when(sentence.rlike(pattern), kind).otherwise(out)
    return out


def severity(kind: Column) -> Column:
    out = F.lit("low")
    for k, s in SEVERITY.items():
        out = F.when(kind == k, s).otherwise(out)
    return out


def is_claim(sentence: Column) -> Column:
    return F.size(T.tokens_by_space(sentence)) >= LEAST_SENTENCE


def contradiction_risk(claim: Column, evidence: Column) -> Column:
    """struct(verdict, confidence): what wording alone says; never that a source
    contradicts a claim."""
    a, b = F.array_distinct(T.ascii_tokens(claim)), F.array_distinct(T.ascii_tokens(evidence))
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    negated, unsure = evidence.rlike(NEGATION), F.lit("insufficient_information")

    def out(verdict: Column, confidence: Column) -> Column:
        return F.struct(verdict.alias("verdict"), confidence.cast("long").alias("confidence"))

    return (
        F.when(F.size(a) == 0, out(unsure, F.lit(0)))
        .when(negated & (share > 0.3), out(unsure, F.least(T.half_even(50 + share * 35), F.lit(85))))
        .when(negated, out(unsure, F.least(T.half_even(20 + share * 30), F.lit(50))))
        .when(share > 0.5, out(F.lit("partially_supported"), F.least(T.half_even(30 + share * 50), F.lit(75))))
        .otherwise(out(unsure, T.half_even(share * 40)))
    )
