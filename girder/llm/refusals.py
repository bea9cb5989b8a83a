"""Sentences that decline an assessment, by their structure: who speaks, a denial, and the act denied.

A sentence declines if it has all three in one language (I / cannot / judge), or if the request, the picture
or the assessment itself is what is denied (no picture seems to be attached). An answer is a refusal if
such sentences, and those that address the reader, make up a good part of it; what else it holds is then
too little for an assessment. Nothing depends on the length of the answer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

#: Share of an answer's words in sentences that decline or address the reader, from which it is a refusal.
DECLINED = 0.25


@dataclass(frozen=True)
class Grammar:
    """Alternatives of a regular expression, each matched as whole words: `speaker` the first person, `denial`, `act` what an
    assessor does, `theme` what the request is about, `failed` how a theme is denied, `reader` the second person and courtesies."""

    speaker: str
    denial: str
    act: str
    theme: str
    failed: str
    reader: str


# Words of the parts of a declining sentence, by language.
GRAMMARS = {
    "en": Grammar(
        speaker=r"i|i'm|i'd|i've|me|my|myself|we|us|our",
        denial=r"\w+n't|cannot|can not|could not|will not|would not|do not|does not|did not|am not|are not|is not|not (?:able|permitted|allowed|willing|in a position|appropriate|possible|qualified|me|us)"
        r"|unable|unwilling|impossible|declin\w*|refus\w*|rather not|pass on|beyond|outside|have no|has no|no way|never|nothing|must not|may not|against",
        act=r"assess\w*|judg\w*|evaluat\w*|determin\w*|identif\w*|review\w*|comment\w*|analy[sz]\w*|inspect\w*|check\w*|rat(?:e|ing)|describ\w*|report\w*|help\w*|assist\w*|answer\w*|respon\w*|repl(?:y|ies)"
        r"|compl(?:y|ete\w*)|fulfil\w*|follow|provid\w*|give|giving|offer\w*|view\w*|load\w*|open\w*|access\w*|process\w*|interpret\w*|permitted|allow\w*|able|say|tell|do|discuss\w*|opinion|verdict|decid\w*|conclu\w*|ask\w*|request\w*|this one|tak(?:e|ing) part",
        theme=r"(?:request|question|task|instruction|assessment|evaluation|judge?ment|determination|answer|image|picture|photo|photograph|attachment|file|report)s?",
        failed=r"(?:did|could|can|was|were|is|are|has|have|will|would|seems?|appears?)(?: not|n't)|cannot|failed|(?:is|are|was|were) (?:missing|unavailable|impossible|declined|beyond|outside)",
        reader=r"you|your|please|thanks?|sorry|apolog\w*|unfortunately|expert|inspector|language model|ai",
    ),
    "de": Grammar(
        speaker=r"ich|mir|mich|mein\w*|wir|uns|unser\w*",
        denial=r"nicht|kein\w*|ablehn\w*|lehne|verweiger\w*|unmöglich|außerstande|nie|weder",
        act=r"(?:be|ver)?urteil\w*|bewert\w*|einschätz\w*|einzuschätzen|prüf\w*|überprüf\w*|analys\w*|beschreib\w*|bestimm\w*|helf\w*|hilfe|beantwort\w*|antwort\w*|erfüll\w*|ansehen|anschau\w*|öffn\w*|laden|verarbeit\w*|möglich|erlaubt|gestattet"
        r"|darf|dürfen|aussage\w*|auskunft|auskünfte|äußern|bilder|tun|ablehn\w*|lehne|leisten|treffen|nachkommen|kommentier\w*|stellung|anfrage|zuständig",
        theme=r"(?:bild|foto|anfrage|frage|aufgabe|prüfung|bewertung|beurteilung|einschätzung|datei|anhang)(?:s|es|er|en)?",
        failed=r"(?:konnte|kann|wurde|wird|lässt sich|ließ sich|ist|liegt|war) (?:leider )?(?:mir )?nicht|fehlt|entfällt|unterbleibt",
        reader=r"sie|ihnen|ihre?|bitte|danke|leid|leider|fachkraft|sprachmodell|ki",
    ),
    "es": Grammar(
        speaker=r"puedo|podré|podría|me|mi|mis|mí|yo|prefiero|debo|estoy|tengo|soy|quiero|lamento|siento|declino|rechazo|logro|corresponde|podemos",
        denial=r"no|ni|nunca|imposible|rechaz\w*|declin\w*|sin|negarme",
        act=r"evalu\w*|juzg\w*|juicio|valor\w*|analiz\w*|análisis|revis\w*|determin\w*|identific\w*|describ\w*|ayud\w*|respond\w*|contest\w*|cumplir|completar|ver|abrir|procesar|posible|autorizad\w*|permit\w*|condiciones|opin\w*|dar|emitir|ofrecer|rechaz\w*|petición|solicitud|corresponde|hacer|comentar",
        theme=r"(?:imagen|foto|fotografía|solicitud|petición|archivo|evaluación|revisión|valoración)",
        failed=r"no (?:(?:se|me|ha|pudo|puede|podrá|sido|ser|es) )*(?:carg\w*|abr\w*|abierta|adjunt\w*|lleg\w*|complet\w*|proces\w*|evalu\w*|valor\w*|respond\w*|atend\w*|posible|disponible)|falta|queda rechazada",
        reader=r"usted|consulte|gracias|disculp\w*|perdón|siento|lamento|técnico|modelo de lenguaje|ia|favor|necesita",
    ),
    "fr": Grammar(
        speaker=r"je|j'\w+|me|m'\w+|moi|mon|ma|mes|nous",
        denial=r"ne|n'\w+|pas|impossible|refus\w*|déclin\w*|aucune?",
        act=r"évalu\w*|jug\w*|analys\w*|examin\w*|détermin\w*|identifi\w*|décri\w*|aid\w*|répond\w*|comment\w*|fourni\w*|donner|voir|ouvrir|possible|impossible|autorisée?|permis|mesure|avis|refus\w*|déclin\w*|demande|prononcer",
        theme=r"(?:image|photo|demande|question|évaluation|analyse|fichier|pièce jointe)s?",
        failed=r"(?:ne|n') ?(?:s'est|peut|a|est|sera|était)\w* (?:pas|plus)|n'(?:est|a|était) pas|manque",
        reader=r"vous|votre|merci|désolée?|excus\w*|veuillez|expert|modèle de langage|ia",
    ),
    "it": Grammar(
        speaker=r"posso|potrei|mi|mio|mia|io|devo|preferisco|sono|rifiuto|declino|riesco|possiamo|dispiace",
        denial=r"non|impossibile|rifiut\w*|declin\w*|nessuna?",
        act=r"valut\w*|giudi\w*|analizz\w*|esamin\w*|determin\w*|identific\w*|descriv\w*|aiut\w*|rispond\w*|forni\w*|dare|vedere|aprire|possibile|impossibile|autorizzat\w*|grado|parere|richiesta|commentare|rifiut\w*|declin\w*",
        theme=r"(?:immagine|foto|richiesta|domanda|valutazione|analisi|file)",
        failed=r"non (?:(?:è|si|può|ha|viene|stat[ao]|essere) )*(?:caric\w*|apr\w*|apert\w*|allegat\w*|valutat\w*|giudicat\w*|possibile|disponibile)|manca",
        reader=r"lei|grazie|scus\w*|dispiace|prego|esperto|modello linguistico|ia|può rivolgersi",
    ),
    "pt": Grammar(
        speaker=r"posso|poderei|consigo|me|meu|minha|eu|devo|prefiro|sou|estou|recuso|lamento|podemos",
        denial=r"não|nem|impossível|recus\w*|declin\w*|nenhuma?",
        act=r"avali\w*|julg\w*|analis\w*|análise|examin\w*|determin\w*|identific\w*|descrev\w*|ajud\w*|respond\w*|fornec\w*|dar|ver|abrir|possível|impossível|autorizad\w*|condições|opini\w*|pedido|solicitação|comentar|recus\w*",
        theme=r"(?:imagem|foto|pedido|solicitação|pergunta|avaliação|análise|arquivo|ficheiro)",
        failed=r"não (?:(?:foi|pode|se|está|ser|é) )*(?:carreg\w*|abr\w*|abert\w*|anexad\w*|avaliad\w*|possível|disponível)|falta",
        reader=r"você|obrigad\w*|desculp\w*|lamento|por favor|consulte|especialista|modelo de linguagem|ia",
    ),
    "nl": Grammar(
        speaker=r"ik|mij|me|mijn|wij|we|ons",
        denial=r"niet|geen|onmogelijk|weiger\w*|afwijz\w*|wijs|nooit",
        act=r"beoordel\w*|oordeel|evalu\w*|analys\w*|controler\w*|bepalen|beschrijven|help\w*|antwoord\w*|beantwoorden|voldoen|geven|bekijken|openen|mogelijk|onmogelijk|toegestaan|staat|verzoek|commentaar|mening|doen|weiger\w*",
        theme=r"(?:afbeelding|foto|verzoek|vraag|beoordeling|bestand|bijlage)",
        failed=r"(?:kon|kan|werd|wordt|is|was) (?:helaas )?niet|ontbreekt",
        reader=r"u|uw|dank\w*|sorry|excuses|helaas|alstublieft|deskundige|taalmodel|ai",
    ),
    "pl": Grammar(
        speaker=r"mogę|mogłabym|mógłbym|mi|mnie|jestem|muszę|wolę|moje|odmawiam|umiem|potrafię|możemy",
        denial=r"nie|niemożliw\w*|odm\w*|żadn\w*",
        act=r"oceni\w*|ocen\w*|osądz\w*|analiz\w*|sprawdz\w*|określ\w*|opis\w*|pomóc|pomoc\w*|odpowied\w*|spełni\w*|poda\w*|zobaczyć|otworzyć|możliw\w*|niemożliw\w*|stanie|prośb\w*|uprawnion\w*|wydać|komentować|odm\w*",
        theme=r"(?:obraz|zdjęci[ea]|prośba|pytanie|ocena|analiza|plik)",
        failed=r"nie (?:został\w*|wczytał\w*|otworzył\w*|jest dostępn\w*)|brakuje",
        reader=r"pan\w*|państwo|dziękuję|przepraszam|niestety|proszę|ekspert\w*|model językowy|ai",
    ),
}

_whole = lambda alternatives: re.compile(rf"(?<!\w)(?:{alternatives})(?!\w)", re.I)
_PARTS = {lang: tuple(_whole(getattr(g, part)) for part in ("speaker", "denial", "act", "reader")) for lang, g in GRAMMARS.items()}
# a theme right before its failure, or denied as such near a word that says what is missing about it
_NO = {"en": "no", "de": "keine?[rn]?", "es": "no (?:hay|llegó|existe|recibí)|ninguna?", "fr": "aucune?|pas d(?:e |')", "it": "nessuna?", "pt": "nenhuma?|não há", "nl": "geen", "pl": "brak|żadne?go?"}
_GONE = r"(?:possible|attached|available|provided|given|loaded|made|received|möglich|beigefügt|vorhanden|angehängt|disponible|adjunta|posible|jointe|possibile|allegata|possível|anexada|mogelijk|bijgevoegd|możliw\w*|załączon\w*)"
_THEMES = {
    lang: (
        _whole(rf"(?:{g.theme})(?: (?:itself|selbst|misma))? (?:{g.failed})"),
        re.compile(rf"(?<!\w)(?:{_NO[lang]})(?: \w+)? (?:{g.theme})(?:(?: \w+){{0,5}} {_GONE}(?!\w)|[^\w]*$|,)|(?<!\w)(?:entfällt|unterbleibt) die (?:{g.theme})|(?<!\w)(?:konnte|kann|wurde) (?:\w+ )?(?:{g.theme}) (?:leider )?nicht", re.I),
    )
    for lang, g in GRAMMARS.items()
}
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")
_WORDS = re.compile(r"\w+")
_RULE = re.compile(r"(?<!\w)(?:rule|regel|regla|règle|regola|regra|reguła)\s*(?:nr\.? ?)?\d", re.I)


_TOKEN = re.compile(r"[\w']+")
_FULL = {lang: (re.compile(g.speaker, re.I), re.compile(g.theme, re.I)) for lang, g in GRAMMARS.items()}


@lru_cache(maxsize=100_000)
def _roles(word: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The languages in which a word is a speaker, and those in which it is a theme."""
    return tuple(tuple(lang for lang, forms in _FULL.items() if forms[i].fullmatch(word)) for i in range(2))


def declines(sentence: str) -> bool:
    """Whether a sentence has speaker, denial and act in one language, or a denied theme."""
    speakers: set[str] = set()
    themes: set[str] = set()
    tokens = _TOKEN.findall(sentence)
    if "'" in sentence:
        tokens += [t.partition("'")[2] for t in tokens if "'" in t]  # l'image is image too
    for spoken, meant in map(_roles, tokens):
        if spoken or meant:
            speakers.update(spoken)
            themes.update(meant)
    if any(p.search(sentence) for lang in sorted(themes) for p in _THEMES[lang]):
        return True
    return any(denial.search(sentence) and act.search(sentence) for _, denial, act, _ in (_PARTS[lang] for lang in sorted(speakers)))


def is_refusal(text: str) -> bool:
    """Whether a text declines an assessment and gives none; one that names a rule by number gives one."""
    text = text.replace("’", "'")
    parts = [(s, declines(s)) for s in _SENTENCE.split(text) if s]
    if not any(d for _, d in parts) or _RULE.search(text):
        return False
    size = [len(_WORDS.findall(s)) for s, _ in parts]
    told = sum(n for n, (s, d) in zip(size, parts, strict=True) if d or any(reader.search(s) for *_, reader in _PARTS.values()))
    return told >= DECLINED * sum(size)
