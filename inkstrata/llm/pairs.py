"""Problem 7: prompt and response pairs whose response is no usable answer.

A multi-label linear classifier (one logistic model a defect) over hashed n-grams of the whole
response, of its last tokens and of the shape of its end, and over features of the pair (tokens in
common, lengths, phrases that the cross parse needs in each language).  It is trained on defects made
from the pairs themselves: responses cut anywhere, copies of the source in another layout, responses
swapped with one in another language, refusals written by a grammar of twelve languages, empty ones;
and on sound ones made hard: cut behind a sentence, made into a list, with an apology before or a
quoted refusal inside.  A second fit leaves out those of the pairs that the first finds broken.  The
thresholds are set on made pairs held out from the fit, sound ones weighted by how common they are.
Scores alone decide truncated, refusal and other_language; empty and copy, whose definitions are
exact, are checked after the classifier chose them.

A null or blank response is ``empty``; a null source or instruction leaves the defects that need it
out; repeated ids give each defect once, from the last delivery.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canon import mix, plain, token_hashes, tokens, transducer
from .common import pieces
from .langid import CODE_OF, LANGUAGES, LETTER, parser_of, reading, script_counts, units_model
from .overlap import kgrams
from .sentences import _CLOSE, _MARKER, LEADING, STOPS, BoundaryModel, _dot

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")
#: Pairs that the fit reads, those with the least hash of their id, and code points of each text of them at most.
FIT_PAIRS, FIT_CHARS = 500, 4000
#: Columns of hashed n-grams; rounds, rate and decay of the fit; how many sound pairs one broken pair stands against.
HASHED, EPOCHS, RATE, DECAY, SOUND = 1 << 17, 60, 0.1, 2e-5, 4.0
#: Weight in the first fits of what is made of responses as they came, some of which are broken themselves.
DOUBT = 0.1
#: Defects whose definition is checked after the classifier chose them, and the share of held-out ones that their thresholds keep.
EXACT, RECALL, MARGIN = ("empty", "copy"), 0.998, 3.0

# What stands for no answer.
FILLERS = {"", "none", "null", "na", "n a", "nil", "nan", "empty", "no output", "no answer", "no response", "no content", "undefined", "blank", "todo", "tbd", "output", "response", "answer", "assistant"}
# How a task is declined, by language, and how something else is offered instead. They only choose the sound pairs of the fit and decide nothing after it.
DECLINES = (
    r"\b(?:i|we) (?:can ?not|can't|could not|couldn't|won't|will not|must (?:decline|refuse|refrain)|have to (?:decline|refuse|pass)|need to decline|am (?:unable|not able|not allowed|not permitted)|would rather not|prefer not|do not feel|don't feel|decline)\b",
    r"\b(?:i'm|i am) (?:sorry|afraid)[, ]+(?:but )?(?:i|this|that)\b|\bi'm (?:unable|not able|not allowed)\b|\bnot (?:something|able|possible for me) (?:i|to)\b|\bunable to (?:assist|help|comply|provide|edit)\b|\bagainst my (?:guidelines|policies|policy|rules)\b|\bas an? (?:ai|assistant|language model)\b|\bsorry, (?:but )?(?:i|that)\b",
    r"\b(?:kann|darf|möchte|werde) (?:ich )?(?:bei |dazu |diese[nrms]? |dabei |ihnen |leider |das )[^.]*\b(?:nicht|keine)\b|\bich (?:kann|darf|möchte|werde)\b[^.]*\b(?:nicht|keine[nr]?)\b|\bmuss ich (?:diese|die|ihre)[^.]*\bablehnen\b|\bals (?:assistent|ki|sprachmodell)\b|\bes tut mir leid\b|\bgegen meine richtlinien\b",
    r"\bje ne (?:peux|suis|souhaite|saurais|veux|dois)\b|\bje (?:préfère|dois) (?:ne pas|refuser|décliner)\b|\ben tant qu['’](?:assistant|ia|intelligence|modèle)\b|\bje suis désolée?\b[^.]*\bmais\b|\bje regrette\b|\bcontraire à mes\b|\bje refuse\b",
    r"\bno puedo\b|\bno me es posible\b|\bprefiero no\b|\b(?:debo|tengo que) (?:rechazar|declinar|negarme)\b|\bcomo (?:asistente|modelo de lenguaje|ia)\b|\blo siento, pero\b|\bno estoy (?:autorizado|en condiciones)\b|\bva en contra de mis\b",
    r"\bnon posso\b|\bnon sono in grado\b|\bpreferisco non\b|\bdevo (?:rifiutare|declinare)\b|\bcome (?:assistente|modello linguistico|ia)\b|\bmi dispiace, ma\b|\bcontro le mie\b",
    r"\bnão (?:posso|consigo|devo|me é possível)\b|\bprefiro não\b|\b(?:preciso|devo|tenho de|tenho que) recusar\b|\bcomo (?:assistente|modelo de linguagem|ia)\b|\bdesculpe, mas\b|\bcontra as minhas\b",
    r"\bkan ik\b[^.]*\bniet\b|\bik (?:kan|mag|wil|zal)\b[^.]*\b(?:niet|geen)\b|\bmoet ik\b[^.]*\bweigeren\b|\bals (?:assistent|ai|taalmodel)\b|\bhet spijt me\b|\btegen mijn richtlijnen\b|\bliever niet\b",
    r"\bне (?:могу|могла бы|мог бы|смогу|буду|имею права)\b|\bвынужден[аы]? отказать|\bпредпочитаю не\b|\bкак (?:ассистент|помощник|языковая модель|ии)\b|\bдолж(?:ен|на) отказать|\bизвините, но\b|\bне в состоянии\b",
    r"(?:できません|できかねます|いたしかねます|お断り(?:し|いた|せ)|お手伝いできない|お答えできない|対応(?:できない|しかねます)|控え(?:させて|ます))",
    r"(?:我(?:无法|不能|没办法|不得不拒绝|必须拒绝|只能拒绝|不便)|(?:抱歉|对不起)[，,]?(?:但)?(?:我|这|無法|无法|不能)|恕我|作为(?:一个)?(?:助手|人工智能|语言模型|ai)|无法(?:协助|帮助|提供|完成|处理|编辑|修改|满足))",
    r"(?:नहीं कर सकता|नहीं कर सकती|असमर्थ हूँ|मना करना|मैं (?:इस|यह)[^।]*नहीं|क्षमा करें, (?:लेकिन|मैं)|माफ़ कीजिए, (?:लेकिन|मैं))",
    r"(?:لا أستطيع|لا يمكنني|لن أتمكن|أعتذر[،,]? (?:لكن|ولكن|لا)|عذر[اًا][،,]? (?:لكن|لا)|غير قادر|أعتذر عن|يجب أن أرفض)",
)
OFFERS = r"\bplease let me know\b|\bif you (?:share|send|provide)\b|\byou may wish\b|\bgerne (?:sehe|helfe|schaue)\b|\bn['’]hésitez pas\b|\benvíe(?:me)?\b|\bsi quiere\b|\bmi mandi\b|\benvie\b|\bstuur\b|\bпришлите\b|お送りください|請提供|请提供|请发|可以换|別の文章|कृपया|من فضلك|أرسل"
_DECLINE, _OFFER = re.compile("|".join(DECLINES)), re.compile(OFFERS)
# Grammar of the refusals made for the fit: openings, cores ({v} is a verb, {o} its object), verbs, objects, reasons, offers; and apologies that refuse nothing.
REFUSALS: dict[str, tuple[tuple[str, ...], ...]] = {
    "en": (
        ("", "", "", "I'm sorry, but ", "I am sorry, but ", "Sorry, ", "Sorry, but ", "I'm afraid ", "Unfortunately, ", "Regrettably, ", "I apologize, but ", "I apologise, however ", "Thank you for asking, but ", "Thanks for the message, but ", "I appreciate the request, but ", "I understand the question; still, ", "As an assistant, ", "As an AI, ", "As a language model, ", "With regret, "),
        ("I cannot {v} {o}", "I can't {v} {o}", "I am unable to {v} {o}", "I'm not able to {v} {o}", "I won't be able to {v} {o}", "I will not {v} {o}", "we cannot {v} {o}", "I must decline to {v} {o}", "I have to refuse to {v} {o}", "I would rather not {v} {o}", "I'd prefer not to {v} {o}", "I'm not allowed to {v} {o}", "I am not in a position to {v} {o}", "I don't feel comfortable if I {v} {o}", "I must refrain from any answer to {o}", "it is not possible for me to {v} {o}", "I have to decline", "I need to decline {o}", "I'll have to pass on {o}", "this is not something I can do", "this is something I must leave alone", "that is beyond what I can do", "this request goes against my guidelines", "my guidelines do not allow {o}", "my policies prevent me from any help with {o}", "I have no way to {v} {o}", "no answer can be given to {o}", "this falls outside what I am permitted to do"),
        ("help with", "assist with", "answer", "edit", "rewrite", "change", "translate", "complete", "continue", "produce", "provide", "write", "create", "work on", "respond to", "fulfil", "support", "process", "handle", "discuss"),
        ("this", "that", "it", "this request", "your request", "this text", "this passage", "this document", "this question", "that content", "this material", "this task", "this one", "such content"),
        ("", "", "", " because the content looks sensitive", ", as it may break the rules", ", since it would not be safe", " for safety reasons", " due to my policies", " at this time", " here"),
        ("", "", "", " Please let me know if there is something else I can do.", " If you send another text, I will gladly look at it.", " You could ask a qualified person instead.", " Feel free to share something different.", " Is there anything else you need?", " Please try a different text."),
        ("Sorry for the delay.", "I apologize for the earlier mistake.", "Sorry to keep you waiting.", "Apologies for the confusion."),
    ),
    "de": (
        ("", "", "Leider ", "Es tut mir leid, aber ", "Entschuldigung, ", "Tut mir leid, ", "Als Assistent ", "Als Sprachmodell ", "Danke für die Anfrage, doch ", "Bedauerlicherweise "),
        ("kann ich {o} nicht {v}", "ich kann {o} nicht {v}", "darf ich {o} nicht {v}", "möchte ich {o} nicht {v}", "werde ich {o} nicht {v}", "ich bin nicht in der Lage, {o} zu {v}", "muss ich {o} ablehnen", "ich muss {o} ablehnen", "kann ich dabei nicht helfen", "kann ich hierzu keine Antwort geben", "darf ich dazu nichts sagen", "ich lehne {o} ab", "ist mir das nicht möglich", "das verstößt gegen meine Richtlinien"),
        ("bearbeiten", "beantworten", "ändern", "übersetzen", "umschreiben", "verfassen", "erstellen", "fortsetzen", "kürzen"),
        ("diesen Text", "diese Anfrage", "diese Bitte", "das", "diesen Inhalt", "Ihre Anfrage", "diese Frage", "dieses Dokument"),
        ("", "", ", da dies gegen meine Regeln verstößt", " aus Gründen der Sicherheit", ", weil der Inhalt heikel ist"),
        ("", "", " Gerne helfe ich bei einem anderen Text.", " Bitte senden Sie einen anderen Text.", " Gerne schaue ich mir etwas anderes an."),
        ("Es tut mir leid für die Verspätung.", "Entschuldigung für das Missverständnis."),
    ),
    "fr": (
        ("", "", "Malheureusement, ", "Je suis désolé, mais ", "Désolée, ", "Désolé, ", "En tant qu'assistant, ", "Je regrette, mais ", "Merci pour la demande, mais "),
        ("je ne peux pas {v} {o}", "je ne suis pas en mesure de {v} {o}", "je ne saurais {v} {o}", "je ne souhaite pas {v} {o}", "il m'est impossible de {v} {o}", "je préfère ne pas {v} {o}", "je dois décliner", "je dois refuser {o}", "je refuse {o}", "je ne suis pas autorisé à {v} {o}", "cela va à l'encontre de mes règles", "je ne peux pas vous aider", "il m'est impossible de vous aider"),
        ("modifier", "traiter", "traduire", "corriger", "réécrire", "produire", "compléter", "aborder", "répondre à"),
        ("ce texte", "cette demande", "cette requête", "ce contenu", "ce passage", "cette question", "votre demande", "ce document"),
        ("", "", " pour des raisons de sécurité", " car le contenu est sensible", " ici"),
        ("", "", " N'hésitez pas à m'envoyer un autre texte.", " Proposez-moi un autre texte.", " Je peux vous aider pour autre chose."),
        ("Désolé pour le retard.", "Pardon pour la confusion."),
    ),
    "es": (
        ("", "", "Lo siento, pero ", "Lamentablemente, ", "Lo lamento, ", "Por desgracia, ", "Como asistente, ", "Disculpe, pero ", "Gracias por la consulta, pero "),
        ("no puedo {v} {o}", "no me es posible {v} {o}", "no estoy en condiciones de {v} {o}", "no estoy autorizado a {v} {o}", "prefiero no {v} {o}", "no voy a {v} {o}", "debo rechazar {o}", "tengo que rechazar {o}", "debo negarme", "tengo que declinar", "no puedo ayudar con {o}", "esto va en contra de mis normas"),
        ("editar", "modificar", "responder", "traducir", "corregir", "reescribir", "producir", "completar"),
        ("este texto", "esta solicitud", "esa petición", "este contenido", "este pasaje", "esta pregunta", "su solicitud"),
        ("", "", " por motivos de seguridad", " porque el contenido es delicado"),
        ("", "", " Si quiere, envíeme otro texto.", " Puedo ayudarle con otra cosa.", " Envíe otro texto, por favor."),
        ("Perdón por la demora.", "Disculpe la confusión."),
    ),
    "it": (
        ("", "", "Mi dispiace, ma ", "Purtroppo ", "Mi spiace, ", "Spiacente, ", "Come assistente, ", "Grazie per la richiesta, ma "),
        ("non posso {v} {o}", "non sono in grado di {v} {o}", "non mi è possibile {v} {o}", "preferisco non {v} {o}", "non intendo {v} {o}", "devo rifiutare {o}", "devo declinare {o}", "non sono in grado di aiutarla", "non posso aiutare con {o}", "questo va contro le mie regole"),
        ("modificare", "rispondere a", "tradurre", "correggere", "riscrivere", "produrre", "completare"),
        ("questo testo", "questa richiesta", "la richiesta", "questo contenuto", "questo brano", "questa domanda"),
        ("", "", " per motivi di sicurezza", " perché il contenuto è delicato"),
        ("", "", " Mi mandi un altro testo.", " Posso aiutarla con altro."),
        ("Scusi il ritardo.", "Mi dispiace per la confusione."),
    ),
    "pt": (
        ("", "", "Desculpe, mas ", "Infelizmente, ", "Lamento, mas ", "Sinto muito, ", "Como assistente, ", "Obrigado pelo pedido, mas "),
        ("não posso {v} {o}", "não consigo {v} {o}", "não me é possível {v} {o}", "não devo {v} {o}", "não estou autorizado a {v} {o}", "prefiro não {v} {o}", "preciso recusar {o}", "tenho de recusar {o}", "devo recusar {o}", "não consigo ajudar com {o}", "isso vai contra as minhas regras"),
        ("editar", "modificar", "responder", "traduzir", "corrigir", "reescrever", "produzir", "completar"),
        ("este texto", "esse pedido", "a solicitação", "este conteúdo", "este trecho", "esta pergunta"),
        ("", "", " por motivos de segurança", " porque o conteúdo é sensível"),
        ("", "", " Envie outro texto, por favor.", " Posso ajudar com outra coisa."),
        ("Desculpe a demora.", "Peço desculpa pela confusão."),
    ),
    "nl": (
        ("", "", "Helaas ", "Het spijt me, maar ", "Sorry, ", "Als assistent ", "Bedankt voor de vraag, maar "),
        ("kan ik {o} niet {v}", "ik kan {o} niet {v}", "mag ik {o} niet {v}", "wil ik {o} liever niet {v}", "ik ben niet in staat om {o} te {v}", "moet ik {o} weigeren", "ik moet {o} weigeren", "moet ik {o} afwijzen", "kan ik u hierbij niet helpen", "dit gaat tegen mijn richtlijnen in"),
        ("bewerken", "beantwoorden", "vertalen", "aanpassen", "herschrijven", "maken", "voltooien"),
        ("deze tekst", "dit verzoek", "deze vraag", "deze inhoud", "dit document", "uw verzoek"),
        ("", "", " om veiligheidsredenen", " omdat de inhoud gevoelig is"),
        ("", "", " Stuur gerust een andere tekst.", " Ik help graag met iets anders."),
        ("Sorry voor de vertraging.", "Excuses voor de verwarring."),
    ),
    "ru": (
        ("", "", "Извините, но ", "К сожалению, ", "Простите, ", "Сожалею, но ", "Как ассистент, ", "Как языковая модель, ", "Спасибо за запрос, но "),
        ("я не могу {v} {o}", "не могу {v} {o}", "я не смогу {v} {o}", "я не буду {v} {o}", "я не вправе {v} {o}", "я не в состоянии {v} {o}", "мне нельзя {v} {o}", "предпочитаю не {v} {o}", "вынужден отказаться", "вынуждена отказать", "я должен отклонить {o}", "не могу помочь с этой просьбой", "это противоречит моим правилам"),
        ("изменить", "обработать", "перевести", "исправить", "переписать", "продолжить", "выполнить"),
        ("этот текст", "эту просьбу", "этот запрос", "это", "этот отрывок", "такой материал"),
        ("", "", " по соображениям безопасности", ", так как тема деликатная"),
        ("", "", " Пришлите, пожалуйста, другой текст.", " Могу помочь с чем-то другим."),
        ("Извините за задержку.", "Простите за путаницу."),
    ),
    "ja": (
        ("", "", "申し訳ありませんが、", "恐れ入りますが、", "すみませんが、", "残念ながら、", "大変申し訳ございませんが、"),
        ("{o}{v}ことはできません", "{o}{v}ことができません", "お手伝いできません", "お手伝いできかねます", "お答えできません", "お断りいたします", "対応いたしかねます", "そのご依頼にはお応えできません", "{o}{v}ことは控えさせていただきます", "ご要望には沿えません"),
        ("編集する", "翻訳する", "書き直す", "修正する", "作成する", "続ける"),
        ("この文章を", "この内容を", "このご依頼を", "その質問を", "この文書を"),
        ("",),
        ("", "", "。別の文章をお送りください", "。他のことでしたらお手伝いします"),
        ("お待たせして申し訳ありません。", "遅くなってすみません。"),
    ),
    "zh": (
        ("", "", "抱歉，", "很抱歉，", "对不起，", "很遗憾，", "不好意思，", "作为助手，"),
        ("我无法{v}{o}", "我不能{v}{o}", "我没办法{v}{o}", "我不便{v}{o}", "我必须拒绝{o}", "我只能拒绝{o}", "恕我不能{v}{o}", "我拒绝{v}{o}", "我不会{v}{o}", "这不符合我的准则", "我帮不了这个忙"),
        ("处理", "修改", "翻译", "编辑", "回答", "提供", "完成", "改写", "协助"),
        ("这个请求", "这一要求", "这段文字", "该内容", "这个问题", "这篇文章", "您的要求"),
        ("", "", "，因为内容敏感"),
        ("", "", "。请换一段文字", "。请提供其他文字", "。我可以帮您做别的事"),
        ("抱歉让您久等了。", "抱歉造成混淆。"),
    ),
    "hi": (
        ("", "क्षमा करें, ", "माफ़ कीजिए, ", "खेद है, ", "दुर्भाग्य से, "),
        ("मैं {o} {v} नहीं सकता", "मैं {o} {v} नहीं सकती", "मैं {o} {v} में असमर्थ हूँ", "मुझे मना करना होगा", "मैं इसमें मदद नहीं कर सकता", "यह मेरे नियमों के विरुद्ध है"),
        ("बदल", "कर", "लिख", "सुधार"),
        ("यह पाठ", "यह अनुरोध", "यह काम", "इस सवाल का उत्तर"),
        ("",),
        ("", " कृपया कोई दूसरा पाठ भेजें।"),
        ("देरी के लिए क्षमा करें।",),
    ),
    "ar": (
        ("", "عذراً، ", "أعتذر، ", "للأسف، ", "شكراً لطلبك، لكن "),
        ("لا أستطيع {v} {o}", "لا يمكنني {v} {o}", "لن أتمكن من {v} {o}", "أنا غير قادر على {v} {o}", "يجب أن أرفض {o}", "أعتذر عن {v} {o}", "هذا يخالف قواعدي"),
        ("تعديل", "ترجمة", "كتابة", "معالجة", "تصحيح"),
        ("هذا النص", "هذا الطلب", "هذا المحتوى", "هذه الفقرة"),
        ("", " لأسباب تتعلق بالسلامة"),
        ("", " أرسل نصاً آخر من فضلك."),
        ("أعتذر عن التأخير.",),
    ),
}
_PREFIXES = ("", "", "", "", "", "[Assistant] ", "**Note:** ", "> ", "- ", "\n", "Answer: ")


def made_refusal(rng: random.Random, language: str) -> str:
    """A refusal written by the grammar."""
    opening, core, verbs, objects, reasons, offers, _ = REFUSALS[language]
    said = rng.choice(opening) + rng.choice(core).format(v=rng.choice(verbs), o=rng.choice(objects)) + rng.choice(reasons)
    stop = {"ja": "。", "zh": "。", "hi": "।"}.get(language, ".")
    end = rng.choice(offers)
    said = said[0].upper() + said[1:] + (end.rstrip("。") + "。" if end[:1] == "。" else stop + end)
    return rng.choice(_PREFIXES) + said


_MARKUP = re.compile(r"<[^<>\n]{0,60}>|```\w*|[*_#>|~`]+|\[/?\w+\]")
_QUOTED = re.compile("[“„«「『\"][^“„«»「」『』”\"]*[”“»」』\"]")
_FENCE = re.compile(r"\n?```\s*$")
_SAYS = re.compile(r"[^\W_]")


def _core(text: str) -> str:
    return " ".join(tokens(_MARKUP.sub(" ", text)))


def is_empty(target: str | None) -> bool:
    """No words of an answer: nothing but marks, markup or a filler."""
    if target is None:
        return True
    bare = _core(target)
    return bare in FILLERS or (not bare and _core(re.sub(r"[\[\]()<>/]", " ", target)) in FILLERS)


_MODEL = BoundaryModel()


def breaks_off(target: str) -> bool:
    """Ends inside a sentence or word; a finished list without final stops does not."""
    text = _FENCE.sub("", target.rstrip()).rstrip()
    text = text.rstrip("*_~`#|")
    if not text:
        return False
    units = _MODEL.units(text)
    last = text[units[-1][0] : units[-1][1]] if units else text
    while last and not (last[-1].isalnum() or last[-1] in STOPS or last[-1] in ",;:，、；：-–—([{«“„「『%°€$" or last[-1] in "”»」』\")]）’'" or "ऀ" <= last[-1] <= "ॿ" or "ً" <= last[-1] <= "ٟ"):
        last = last[:-1]  # emoji and the like after the last sentence
    if not last:
        return False
    end = last.rstrip("”»」』\"')]）’“   ")
    if end and end[-1] in STOPS:
        for a, b in _CLOSE.items():
            if a != b and a != "„" and last.count(a) > last.count(b) + (last.count("“") if b == "”" and "„" in last else 0) and a in "“«「『":
                return True
        if last.count('"') % 2 or (last.count("(") > last.count(")") and not last.lstrip().startswith("(")):
            return True
        stop = re.search(f"[{STOPS}]+$", end)[0]
        if stop in ("…", "...", "……", "……."):
            return True
        if stop == "." and len(end) == len(last):
            words = end[:-1].split()
            raw = words[-1].lstrip("([{“„«") if words else ""
            prev = words[-2] if len(words) > 1 and words[-2].endswith(".") else ""
            return bool(raw) and _dot(raw, prev, text.isupper())[1] in ("abbr", "initial", "letter")
        return False
    if last.split()[-1].lower() in LEADING:
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    items = [x for x in lines if _MARKER.match(x.strip())]
    if len(items) >= 2 and _MARKER.match(lines[-1].strip()) and last[-1] not in ",;:([{-–—":
        bare = sum(x.rstrip()[-1] not in STOPS for x in items[:-1])
        return bare * 2 < len(items) - 1
    return True


def copies(source: str, target: str, s: list[str] | None = None, t: list[str] | None = None) -> bool:
    """The source's words unchanged, after a lead-in line or none; s and t are their tokens, where they are at hand."""
    s, t = tokens(source) if s is None else s, tokens(target) if t is None else t
    if not s or len(t) < len(s) or t[len(t) - len(s) :] != s:
        if not s or not (_MARKUP.search(source) or _MARKUP.search(target)):
            return False
        s, t = tokens(_MARKUP.sub(" ", source)), tokens(_MARKUP.sub(" ", target))
        if not s or t[len(t) - len(s) :] != s:
            return False
    lead = len(t) - len(s)
    if lead == 0:
        return True
    line, _, rest = target.strip().partition("\n")
    if not rest.strip():
        line, _, rest = target.strip().partition(":")
    if len(tokens(rest)) <= len(s) + 1 and len(tokens(line)) <= lead + 1:
        return True
    line, _, rest = target.strip().partition(":")  # the lead-in stands on the copy's own first line
    return len(tokens(rest)) <= len(s) + 1 and len(tokens(line)) <= lead + 1


def _said(unit: str) -> str:
    """A unit without quoted speech, in lower case."""
    return transducer().native(_QUOTED.sub(" ", unit)).lower().replace("’", "'")


def decline_share(target: str) -> tuple[float, float, int]:
    """Share of units that decline, share that decline or offer, and number of units; quoted speech left out."""
    text = re.sub(r"^\s*(?:\[\w+\]|>|\*\*|[-*])\s*", "", target)
    units = [text[a:b] for a, b in _MODEL.units(text)]
    units = [_said(u) for u in units if _SAYS.search(u)]
    if not units:
        return 0.0, 0.0, 0
    no = [bool(_DECLINE.search(u)) for u in units]
    either = [a or bool(_OFFER.search(u)) for a, u in zip(no, units, strict=True)]
    return sum(no) / len(units), sum(either) / len(units), len(units)


def wanted_language(instruction: str | None) -> str | None:
    """The language that an instruction names."""
    for word in re.findall(r"[^\W\d_]{4,}", instruction or ""):
        code = CODE_OF.get(word.lower())
        if code:
            return code
    return None


def end_shape(text: str, unit: str) -> list[str]:
    """What the end of a response looks like: its last sign, stop, word class, open quotes and brackets, and the list it may stand in."""
    text = _FENCE.sub("", text.rstrip()).rstrip().rstrip("*_~`#|")
    last = unit.rstrip("*_~`#|")
    odd = ""
    while last and not (last[-1].isalnum() or unicodedata.category(last[-1])[0] in "PM" or last[-1] in "°€$+=<"):
        last, odd = last[:-1].rstrip(), "odd"  # emoji and the like behind the last sentence
    if not last:
        return ["none"]
    bare = last.rstrip("”»」』\"')]）’“")
    stop = (m := _STOPPED.search(bare)) and m[0] or ""
    kind = "ellipsis" if "…" in stop or ".." in stop or "‥" in stop else stop[:1] or ("word" if last[-1].isalnum() or unicodedata.category(last[-1])[0] == "M" else last[-1])
    open_quote = any(last.count(a) > last.count(b) for a, b in (("“", "”"), ("«", "»"), ("「", "」"), ("『", "』")) if not (a == "“" and "„" in last)) or last.count("„") > last.count("“") + last.count("”") or last.count('"') % 2 == 1
    open_bracket = last.count("(") > last.count(")") or last.count("（") > last.count("）")
    before = "plain"
    if stop == "." and len(bare) == len(last):
        words = bare[:-1].split()
        raw = words[-1].lstrip("([{“„«") if words else ""
        before = _dot(raw, words[-2] if len(words) > 1 and words[-2].endswith(".") else "", text.isupper())[1] if raw else "bare"
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    items = [x for x in lines if _MARKER.match(x)]
    listed = "none"
    if len(items) >= 2 and lines and _MARKER.match(lines[-1]):
        listed = "stopped" if 2 * sum(x[-1] not in STOPS for x in items[:-1]) >= len(items) - 1 else "bare"
        listed = "bare" if listed == "stopped" else "stopped"
    word = last.split()[-1].lower()
    lead = "lead" if word in LEADING else "short" if len(word) <= 2 else ""
    quote, bracket = "quote" if open_quote else "", "bracket" if open_bracket else ""
    return [f"s {kind}", f"s {kind} {quote} {bracket}", f"s {kind} {before}", f"s {kind} {listed}", f"s {kind} {quote} {bracket} {before} {listed} {lead}", f"l {lead} {kind}", f"o {odd} {kind}"]


_STOPPED = re.compile(f"[{STOPS}]+$")
#: Dense features of a pair.
DENSE = 40


class Features:
    """Sparse rows: for each entry its row, column and value; the last DENSE columns are features of the pair."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int) -> None:
        self.row, self.column, self.value, self.rows = row, column, value, rows

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, self.value * w[self.column, d], self.rows) for d in range(w.shape[1])], axis=1)

    def transposed_times(self, g: np.ndarray, columns: int) -> np.ndarray:
        return np.stack([np.bincount(self.column, self.value * g[self.row, d], columns) for d in range(g.shape[1])], axis=1)

    def take(self, keep: np.ndarray) -> Features:
        number = np.cumsum(keep) - 1
        own = keep[self.row]
        return Features(number[self.row[own]], self.column[own], self.value[own], int(keep.sum()))


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[float, float, int]:
    """Share of b's tokens that a has, share of a's that b has, and length of the longest common ending."""
    if not len(a) or not len(b):
        return 0.0, 0.0, 0
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    x, y = a.tolist(), b.tolist()
    in_a, in_b = set(x), set(y)
    return sum(t in in_a for t in y) / len(y), sum(t in in_b for t in x) / len(x), int(n if same.all() else same.argmin())


class Featurizer:
    """Features of pairs; languages by cross parsing."""

    def __init__(self, reference: dict[str, str]) -> None:
        self.parser, self.model = parser_of(reference), units_model(reference)

    def __call__(self, pairs: list[tuple[str | None, str | None, str | None]]) -> Features:
        """Features of (instruction, source, target)."""
        bare = [_MARKUP.sub(" ", t or "") for _, _, t in pairs]
        sources, targets = [reading(s or "") for _, s, _ in pairs], [reading(t) for t in bare]
        number: dict[str, int] = {}
        of = [number.setdefault(r, len(number)) for r in sources + targets]  # equal texts are parsed once
        cost = self.parser.phrases(list(number))[of]
        counted = script_counts(list(number))[:, LETTER:].sum(axis=1)[of]
        hashes, offsets = token_hashes([plain(t) for t in bare])
        own, begin = token_hashes([plain(_MARKUP.sub(" ", s or "")) for _, s, _ in pairs])
        size = np.diff(offsets)
        # Whole response without quoted speech, which tells what others said: single tokens and pairs of them, by their share of it.
        said, at = token_hashes([plain(_QUOTED.sub(" ", t)) for t in bare])
        count = np.diff(at)
        owner = np.repeat(np.arange(len(pairs)), count)
        two = kgrams(said, 2)
        whole = owner[: len(two)] == owner[1:] if len(two) else np.zeros(0, bool)
        row, column, value = [owner, owner[: len(two)][whole]], [said % HASHED, two[whole] % HASHED], [6.0 / np.maximum(count, 3)[o] for o in (owner, owner[: len(two)][whole])]
        for back in (1, 2, 3):  # its last tokens, each with its distance from the end
            some = np.flatnonzero(size >= back)
            row.append(some)
            column.append(mix(hashes[offsets[some + 1] - back] ^ np.uint64(0xA5A5 * back)) % HASHED)
            value.append(np.full(len(some), 0.4))
        shapes, dense = ([], []), np.zeros((len(pairs), DENSE))
        for i, (instruction, source, target) in enumerate(pairs):
            text = target or ""
            units = self.model.units(text)
            for g in end_shape(text, text[units[-1][0] : units[-1][1]] if units else ""):
                shapes[0].append(i)
                shapes[1].append(zlib.crc32(g.encode("utf-8", "surrogatepass")) % HASHED)
            a, b = own[begin[i] : begin[i + 1]], hashes[offsets[i] : offsets[i + 1]]
            taken, kept, ending = _shared(a, b)
            changed, lead = len(a) - ending, len(b) - ending
            named = wanted_language(instruction)
            of_source, of_target = cost[i], cost[len(pairs) + i]
            expected = LANGUAGES.index(named) if named else int(of_source.argmin()) if counted[i] >= 8 else -1
            letters, least = counted[len(pairs) + i], float(of_target.min())
            margin = float(of_target[expected] - least) if expected >= 0 and letters >= 4 else 0.0
            part = margin / (least + 1)
            has = len(a) > 0
            dense[i] = [
                *(len(b) == k for k in range(4)), np.log1p(len(b)) / 6, len(units) / (len(units) + 3.0), has, taken, kept, taken * kept,
                *(has and len(b) > 0 and changed == k for k in range(3)), has and changed > 2, has and changed == 0 and lead == 0, has and changed == 0 and 0 < lead <= 12, has and changed == 0 and lead > 12,
                min(max((np.log1p(len(b)) - np.log1p(len(a))) / 3, -2), 2) if has else 0.0, has and len(b) < 0.4 * len(a), has and len(b) < 0.15 * len(a),
                *(margin >= k for k in (1, 2, 3, 5, 8, 12, 20)), min(part, 1.0), *(part >= k for k in (0.04, 0.08, 0.12, 0.2, 0.3)), margin >= 3 and part >= 0.08, margin >= 5 and part >= 0.15, named is not None, expected < 0, letters < 20, not text.strip(), 1.0,
            ]
        i, k = np.nonzero(dense)
        row += [np.array(shapes[0], np.int64), i]
        column += [np.array(shapes[1], np.uint64), (HASHED + k).astype(np.uint64)]
        value += [np.full(len(shapes[0]), 0.5), dense[i, k]]
        return Features(np.concatenate(row).astype(np.int64), np.concatenate(column).astype(np.int64), np.concatenate(value).astype(np.float64), len(pairs))


def _stretch(text: str, rng: random.Random) -> str:
    """A few sentences of a reference text."""
    at = _STOP_AND_BLANK.search(text, rng.randrange(max(1, len(text) - 400)))
    begin = at.end() if at else 0
    end = _STOP_AND_BLANK.search(text, begin + rng.randrange(20, 300))
    return text[begin : end.end() if end else begin + 300]


_STOP_AND_BLANK = re.compile(f"[{STOPS}]+\\s*")


def _made(pairs: list[tuple[str | None, str, str]], rng: random.Random, languages: list[int], source_languages: list[int], reference: dict[str, str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Training pairs with made defects, and sound ones that are easily taken for broken; their labels, the pair that each is made of, and what of it: 2 the pair as it came, 1 its response, 0 neither."""
    rows, labels, owner, kind = [], [], [], []

    def add(pair: tuple, *defects: str, of: int | None = None) -> None:
        rows.append(pair)
        labels.append([d in defects for d in DEFECTS])
        owner.append(i if of is None else of)
        kind.append(2 if pair == pairs[i] else 0 if {"refusal", "empty", "copy"} & set(defects) else 1)

    model = units_model(reference)
    for i, (instruction, source, target) in enumerate(pairs):
        add((instruction, source, target))
        units = model.units(target)
        language, named = LANGUAGES[languages[i]], wanted_language(instruction)
        foreign = ("other_language",) if named and source and LANGUAGES[source_languages[i]] != named else ()  # the source instead of its translation
        for _ in range(2):  # cut anywhere but behind a stop; what follows a cut may be left as dots
            at = rng.randrange(max(1, len(target) // 6), len(target)) if len(target) > 12 else 0
            if at and target[at - 1] not in STOPS and target[at - 1].isalnum() and not any(e <= at and not target[e:at].strip() for _, e in units) and any(a < at < e - 1 for a, e in units):
                add((instruction, source, target[:at].rstrip() + rng.choice(_TORN)), "truncated")
        if units and rng.random() < 0.3:  # broken off behind a sentence, as a mark says
            add((instruction, source, target[: rng.choice(units)[1]] + rng.choice((" (", " [cut]", " [truncated]", " [...]", " “", ", and"))), "truncated")
        inner = [k + 1 for a, e in units for k in range(a, e - 2) if target[k] == "." and target[k + 1].isspace()]
        if inner:  # behind a dot that ends nothing
            add((instruction, source, target[: rng.choice(inner)]), "truncated")
        if len(units) > 1:
            k = rng.randrange(1, len(units))
            if target[units[k - 1][1] - 1] in STOPS + "”»」』\"":
                add((instruction, source, target[: units[k - 1][1]]))  # whole, though shorter
            clean = [target[a:e].rstrip(STOPS) for a, e in units[:6]]
            mark = rng.choice(("- ", "* ", "• ", "1. "))
            listed = [(f"{n + 1}. " if mark == "1. " else mark) + c for n, c in enumerate(clean)]
            if len(clean) > 2:
                add((instruction, source, "\n".join(listed)))
                last = listed[-1]
                if len(last) > 24 and last[len(last) // 2 - 1].isalnum():
                    stopped = [x + rng.choice((";", ".")) for x in listed[:-1]]
                    add((instruction, source, "\n".join([*stopped, last[: len(last) // 2]])), "truncated")
        if (short := _SAYING.findall(target)) and rng.random() < 0.4:  # an answer of a word or two
            add((instruction, source, " ".join(short[rng.randrange(len(short)) :][: rng.randrange(1, 4)]).capitalize() + rng.choice((".", ".", f", {rng.randrange(1500, 2030)}."))))
        if source and (parts := model.units(source)):
            shown = rng.choice((source, source, source.upper(), source.lower(), source.replace(" ", "\n", 3), rng.choice(("Here is the text:", "Result:", "Sure, here you go:", "Voici le texte :", "Hier ist der Text:")) + "\n" + source, source.replace(", ", " "), "> " + source, f"**{source}**"))
            add((instruction, source, shown), "copy", *foreign, *(("truncated",) if breaks_off(source) else ()))
            words = [m.span() for m in _SAYING.finditer(source)]
            if len(words) > 3:  # one word changed is no copy
                (a, e), (b, f) = rng.sample(words, 2)
                if source[a:e].lower() != source[b:f].lower() and not breaks_off(source):
                    add((instruction, source, source[:a] + source[b:f] + source[e:]), *foreign)
            if len(parts) > 2 and not breaks_off(source):
                add((instruction, source, source[: parts[-2][1]]), *foreign)
        other = [j for j in (rng.randrange(len(pairs)) for _ in range(6)) if languages[j] != languages[i]]
        speaks = rng.choice([x for x in LANGUAGES if x != language and len(reference.get(x, "")) > 40] or [""])
        if speaks and speaks != named and (said := _stretch(reference[speaks], rng).strip()):
            add((instruction, source, said), "other_language", *(("truncated",) if breaks_off(said) else ()))
        if other and LANGUAGES[languages[other[0]]] != named:
            swapped = pairs[other[0]][2]
            add((instruction, source, swapped), "other_language", of=other[0])
            if len(swapped) > 40 and breaks_off(swapped[: 2 * len(swapped) // 3]):
                add((instruction, source, swapped[: 2 * len(swapped) // 3]), "other_language", "truncated", of=other[0])
        for speaks in (language, rng.choice(list(REFUSALS)), "en"):
            if speaks in REFUSALS:
                said = made_refusal(rng, speaks)
                add((instruction, source, said), "refusal", *(("other_language",) if speaks != language else ()))
        if len(units) > 1 and rng.random() < 0.5:  # told within an answer, or an apology before one
            said = made_refusal(rng, language).lstrip(">*[-").strip()
            opens, closes = rng.choice((("“", "”"), ("„", "“"), ("«", "»"), ('"', '"'))) if language not in ("ja", "zh") else ("「", "」")
            told = f"{opens}{said}{closes} " + rng.choice(("said Ann. ", "— Ann. ", "wrote Ann in the reply. "))
            at = units[rng.randrange(1, len(units))][0]
            add((instruction, source, target[:at] + told + target[at:]))
            add((instruction, source, rng.choice(REFUSALS[language][6]) + " " + target))
        if i % 2 == 0:
            filler = rng.choice(sorted(FILLERS))
            said = rng.choice(("{}", "{}", "[{}]", "({})", "<p>{}</p>", "```\n{}\n```", '"{}"', "**{}**", "{}.", "- {}")).format(rng.choice((filler, filler.upper(), filler.capitalize())))
            add((instruction, source, rng.choice((None, "", " ", "\n", "-", "...", "***", "—", "?", *[said] * 9))), "empty")
    return rows, np.array(labels, np.float64), np.array(owner), np.array(kind)


#: What may stand behind a cut.
_TORN = ("", "", "", "", "", "", "…", "...", " ...", "-", ",", " (", " [cut]", " [truncated]", " […]")
_SAYING = re.compile(r"[^\W\d_]{4,}")


class PairClassifier:
    """Weights and thresholds, one column a defect."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def scores(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.times(self.weights), -30, 30)))


def _fitted(x: Features, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression of each defect: Adam on the whole sample, rows weighted."""
    w = np.zeros((HASHED + DENSE, y.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        g = x.transposed_times((p - y) * weight[:, None], len(w)) / max(1, x.rows) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def _threshold(p: np.ndarray, truth: np.ndarray) -> float:
    """The score of the best F1 on held-out pairs, where a sound pair counts SOUND times; in the middle of the gap where several are equally good."""
    if not truth.any():
        return 0.5
    odds = np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    order = np.argsort(-odds, kind="stable")
    hits, false = np.cumsum(truth[order]), SOUND * np.cumsum(~truth[order])
    f1 = 2 * hits / (hits + false + truth.sum())
    best = int(len(f1) - 1 - f1[::-1].argmax())
    low = odds[order[best + 1]] if best + 1 < len(order) else odds[order[best]] - 1.0
    return float(1 / (1 + np.exp(-(odds[order[best]] + low) / 2)))


def fit_pairs(pairs: list[tuple[str | None, str | None, str | None]], reference: dict[str, str], seed: int = 7) -> PairClassifier:
    """Fits on made defects of the pairs; a third of them is held out for the thresholds. Pairs that the first fit finds broken are left out of the second."""
    features, rng = Featurizer(reference), random.Random(seed)
    pairs = [p for p in pairs if p[2] and p[2].strip()]
    sound = [p for p in pairs if not (decline_share(p[2])[0] > 0 or is_empty(p[2]) or breaks_off(p[2]) or (p[1] and copies(p[1], p[2])))] or pairs
    if not sound:
        return PairClassifier(np.zeros((HASHED + DENSE, len(DEFECTS))), np.full(len(DEFECTS), 0.5))
    cost = features.parser.phrases([reading(p[2]) for p in sound] + [reading(p[1] or "") for p in sound]).argmin(axis=1).tolist()
    rows, y, owner, kind = _made(sound, rng, cost[: len(sound)], cost[len(sound) :], reference)
    x = features(rows)
    # Each half of the pairs is judged by a fit on what is made of the other half; what it finds broken is left out of the fit that counts.
    broken = np.zeros(len(sound), bool)
    for half in (0, 1):
        own, other = (kind == 2) & (owner % 2 == half), owner % 2 != half
        if own.any() and other.any():
            found = PairClassifier(_fitted(x.take(other), y[other], np.where(kind > 0, DOUBT, 1.0)[other]), np.zeros(0)).scores(x.take(own))
            broken[owner[own]] = found.max(axis=1) >= 0.5
    kept = ~broken[owner] if not broken.all() else np.ones(len(rows), bool)
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 0 for i in range(len(rows))])
    model = PairClassifier(_fitted(x.take(kept & ~held), y[kept & ~held], np.ones(int((kept & ~held).sum()))), np.full(len(DEFECTS), 0.5))
    if (kept & held).any():
        p, truth = model.scores(x.take(kept & held)), y[kept & held] > 0.5
        for d, name in enumerate(DEFECTS):
            found = np.sort(p[truth[:, d], d])
            if name in EXACT and len(found):  # the exact check settles precision: nearly all held-out cases are kept, with a margin of MARGIN in log odds
                least = min(0.5, max(1e-9, float(found[int((1 - RECALL) * len(found))])))
                model.thresholds[d] = 1 / (1 + math.exp(MARGIN - math.log(least / (1 - least))))
            elif len(found):
                model.thresholds[d] = _threshold(p[:, d], truth[:, d])
    return model


def broken_pairs(df: DataFrame, id_col: str, reference: dict[str, str], source: str = "source", target: str = "target", instruction: str = "instruction", order: str | None = None) -> DataFrame:
    """``id, defect, score`` of every defect of every pair, repeated ids once."""
    rows = df.select(F.col(id_col).alias("id"), F.col(instruction).alias("i"), F.col(source).alias("s"), F.col(target).alias("t"), (F.col(order) if order else F.lit(0)).alias("o")).where("id is not null")
    spark = df.sparkSession
    total = rows.count()
    part = min(1.0, 4.0 * FIT_PAIRS / max(1, total))
    h = F.xxhash64("id")
    near = rows.where(F.pmod(h, F.lit(1 << 20)) < int(part * (1 << 20)) + 1).where(f"coalesce(length(s), 0) <= {FIT_CHARS} and coalesce(length(t), 0) <= {FIT_CHARS}")
    sample = near.dropDuplicates(["id"]).withColumn("h", h).orderBy("h").limit(FIT_PAIRS).select("i", "s", "t", "h").repartition(1).sortWithinPartitions("h", "t")
    known = spark.sparkContext.broadcast(reference)  # bounded by its parameters

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit_pairs([r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)], known.value)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))], ["weights", "thresholds"])

    fitted = sample.mapInArrow(fit, "weights binary, thresholds array<double>").first()  # one task fits, the driver gets the weights
    weights = np.frombuffer(fitted.weights, np.float32).reshape(-1, len(DEFECTS)) if fitted else np.zeros((HASHED + DENSE, len(DEFECTS)), np.float32)
    sent = spark.sparkContext.broadcast((reference, PairClassifier(weights, np.array(fitted.thresholds if fitted else [0.5] * len(DEFECTS)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, clf = sent.value
        features = Featurizer(ref)
        for b in pieces(batches, 2, 3):
            pairs = list(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True))
            p = clf.scores(features(pairs))
            found = []
            for (_, s, t), scores in zip(pairs, p, strict=True):
                own = {d: float(x) for d, x, least in zip(DEFECTS, scores, clf.thresholds, strict=True) if x >= least}
                if "empty" in own and is_empty(t):
                    own = {"empty": own["empty"]}
                else:
                    own.pop("empty", None)
                if "copy" in own and not (s and t and copies(s, t)):
                    own.pop("copy")
                if "refusal" in own:
                    own.pop("other_language", None)
                found.append([{"defect": d, "score": round(x, 6)} for d, x in own.items()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), pa.array(found, pa.list_(pa.struct([("defect", pa.string()), ("score", pa.float64())])))], ["id", "o", "found"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind('id')}, o {kind('o')}, found array<struct<defect: string, score: double>>")
    last = out.groupBy("id").agg(F.max_by("found", F.struct(F.col("o").isNotNull(), "o")).alias("found"))
    return last.select("id", F.explode("found").alias("f")).select("id", "f.defect", "f.score")
