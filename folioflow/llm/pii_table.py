"""The small labelled table that the model for personal information is trained from.

Sentences in several languages with marked slots; every slot is filled by rule with invented
particulars (seeded, so the table is the same everywhere). ``rows()`` gives
``(text, [(start, end, type)])``.
"""

from __future__ import annotations

import random
import re

# Slots: N name, E email, P phone, I identity number, A address (by language), V plain number, W plain word.
SENTENCES = """
en|Please thank Dr. {N} for the corrections.|Please thank Prof. {N} for this.|Please thank Ms. {N} for the notes.|According to {N}, the table is out of date.|According to {N}, the second draft is better.|The note was signed by {N}.|{N} asked for a third reading.|{N} wrote the appendix.|Mr {N} called about it.|Signed, {N}|Reviewed by {N} last week.
en|Send corrections to {E} before Friday.|Contact: {E}.|The clean copy went to {E}, not to the list.|Write to {E} instead.|Phone {P} (mornings only).|Call {P} if the file does not open.|My desk is {P}; leave a message.|Questions to {P} please.|Tel. {P}|Fax: {P}
en|The author’s social security number, {I}, must not be printed.|The contract names the author by number {I}.|Passport {I} was scanned with the form.|ID: {I}.|Identity card {I} is enclosed.|Her tax number is {I}.
en|Proofs are posted to {A}.|Return address: {A}.|The author has moved to {A}, and works from there.|Send the parcel to {A}.
de|Bitte Frau {N} für die Hinweise danken.|Bitte Herrn {N} danken.|Unterschrieben hat den Vermerk {N}.|{N} bat um eine dritte Lesung.|Laut {N} ist die Tabelle veraltet.|Der Hinweis stammt von {N}.|Korrekturen bitte an {E} senden.|Kontakt: {E}.|Die Reinschrift ging an {E}.|Rückfragen unter {P}.|Tel. {P} (nur vormittags).|Telefonisch bin ich unter {P} zu erreichen.|Rufen Sie {P} an.
de|Die Steuernummer {I} steht noch im Vertrag.|Ausweis Nr. {I} liegt als Scan bei.|Im Vertrag steht die Nummer {I}.|Reisepass {I} liegt bei.|Die Fahnen gehen per Post an: {A}.|Neue Anschrift der Verfasserin: {A}.|Rücksendung an {A}.
fr|Remerciez Mme {N} pour ses remarques.|Merci à M. {N} pour ses notes.|La note est signée par {N}.|{N} a demandé une troisième lecture.|Selon {N}, le tableau est dépassé.|Envoyez les corrections à {E} avant vendredi.|Contact : {E}.|La copie propre est partie chez {E}.|Appelez le {P} si le fichier ne s’ouvre pas.|Tél. : {P}.|Mon poste : {P}.
fr|Le contrat porte encore le numéro de sécurité sociale {I}.|Le passeport {I} est joint au formulaire.|La carte d’identité {I} est jointe.|Les épreuves sont envoyées au {A}.|Adresse de retour : {A}.
es|Gracias a la Sra. {N} por sus notas.|Agradezca al Sr. {N} sus notas.|La nota está firmada por {N}.|{N} pidió una tercera lectura.|Según {N}, la tabla está anticuada.|Envíe las correcciones a {E} antes del viernes.|Contacto: {E}.|La copia limpia fue a {E}.|Llame al {P} si el archivo no se abre.|Tel.: {P}.|El contrato lleva todavía el DNI {I}.|El pasaporte {I} está en el formulario.|Las pruebas se envían a {A}.|Enviar las pruebas a {A}.|Dirección de devolución: {A}.
it|Ringraziare la dott.ssa {N} per i rilievi.|La nota è firmata da {N}.|{N} ha chiesto una terza lettura.|Secondo {N} la tabella è superata.|Inviare le correzioni a {E} entro venerdì.|Contatto: {E}.|La copia è andata a {E}.|Chiamare il {P} se il file non si apre.|Tel. {P}.|Il contratto riporta ancora il codice {I}.|Il passaporto {I} è allegato al modulo.|Le bozze si spediscono in {A}.|Indirizzo per il reso: {A}.
pt|Agradeça à Sra. {N} pelas notas.|A nota está assinada por {N}.|{N} pediu uma terceira leitura.|Envie as correções para {E} até sexta.|Contacto: {E}.|Ligue para {P} se o ficheiro não abrir.|O contrato ainda traz o número de identificação {I}.|O passaporte {I} vai com o formulário.|As provas seguem para {A}.|Morada de devolução: {A}.|Morada para devolução: {A}.
nl|Met dank aan mevr. {N} voor de opmerkingen.|{N} vroeg om een derde lezing.|De nota is ondertekend door {N}.|Volgens {N} is de tabel verouderd.|Stuur verbeteringen naar {E} vóór vrijdag.|Contact: {E}.|Bel {P} als het bestand niet opent.|In het contract staat nog het nummer {I}.|Paspoort {I} is bijgevoegd.|De proeven gaan naar {A}.|Retouradres: {A}.|De proeven gaan per post naar {A}.
pl|O trzecie czytanie prosi {N}.|Notatkę podpisała {N}.|Proszę podziękować pani {N}.|Poprawki proszę wysłać na {E} do piątku.|Proszę dzwonić pod {P}, jeśli plik się nie otwiera.|W umowie jest jeszcze numer {I}.|Odbitki wysyłamy na adres: {A}.
ru|Заметку подписал {N}.|О третьем чтении просит {N}.|Исправления присылайте на {E} до пятницы.|Звоните по номеру {P}, если файл не открывается.|В договоре указан паспорт {I}.|Гранки отправляются по адресу: {A}.
uk|Замітку підписав {N}.|Про третє читання просить {N}.|Виправлення надсилайте на {E}.|Телефонуйте за номером {P}.|У договорі вказано паспорт {I}.
ja|修正は {E} までお送りください。|ファイルが開かない場合は {P} にお電話ください。|契約書の番号は {I} です。|校正刷りの送付先：{A}。|担当：{N}。|三度目の校正を求めたのは{N}さんです。
zh|请将修改发送至 {E}。|如文件无法打开，请致电 {P}。|合同上的证件号码是 {I}。|校样寄往：{A}。|联系人：{N}。|第三次校对由{N}提出。
xx|© {N}.|© {N}|✉ {E}.|☎ {P}.|ID: {I}.|✎ {A}.|-- ⏎{N}⏎{E} | {P}⏎|-- ⏎{N}⏎{E}⏎|[The editor moved it.]{{.deletion id="3" author="{N}" date="2025-03-17T00:38:00Z"}}.|[Das bleibt.]{{.insertion id="12" author="{N}" date="2024-07-19T06:54:00Z"}}|[x]{{.comment-start id="7" author="{N}" date="2026-09-10T04:11:00Z"}}|{E} | {P}|© {N}。|© {N}।|1. © {N}.|+ ✉ {E}.|- ☎ {P}.|  ID: {I}.
no|ISBN 979-0-99-{V}1482-3.|ISBN {V}{V}-{V}1482-3.|ISSN {V}{V}-{V}{V}.|ISSN {V}{V}-{V}{V}5.|ISSN {V}{V}-{V}{V}X.|doi:10.99999/draft.2021.{V}.|commit 4f9a{V}c1e07b.|build 20240305-11{V}2.|order no. 77-1{V}-2093.|version 2.14.{V}.|§ 12.{V}.3.|lines 120–1{V}.|table 5.{V}: 1 204 rows.|{V}.000.000 characters.|10:{V}5–11:30.|192 × 1{V}8 mm.|2021-06-{V}.|[@miller20{V}; @brown19{V}].|user@@{{name}}.|@media print.|The file at files.company.example/v3.{V}/start.html was not changed.
no|St. Mary Handbook, Part {V}.|St. Paul Guide, Vol. {V}.|Garden Handbook, Part {V}.|Chapter May Gardens.|Section Grant Notes.|Will Grant, page {V}.|Chapter Rose Meadow.|Track Changes.|Fixed a typo|Merge branch main|({W}).|The caption of figure {V} was kept ({W}).|See Fig. {V} and Sect. 4.2 for the details, e.g. the old wording.|The share rose from 3.{V} to 12.75 per cent vs. the first draft.|Did the editor (who read it twice!) accept change no. {V}?|The U.S. edition keeps the comma, the U.K. one does not.|Prof. K. L. and the other reviewers (cf. App. B, p. {V}) agreed.|“We keep it. It reads well,” said the note from the publisher.|The new wording costs approx. $8.50 a page.|Track {W} in Word for Windows.
no|Der Anteil stieg von 3,{V} auf 1.234,5 Zeichen bzw. Wörter.|Am 3. März wurde Nr. {V} von Dr. K. geprüft.|Vgl. hierzu Abb. {V} und Kap. 4.2, z. B. die alte Fassung.|Die Lektorin ergänzte die Überschrift des Kapitels in Version {V}.|Unsere Arbeitsgruppe strich den Abschnitt über die Methode auf Wunsch des Verlags.|M. K. et Mme L. (cf. chap. {V}) ont accepté la note.|Voir p. {V} et fig. 4.2, c.-à-d. l’ancienne formulation.|El Dr. K. y la Sra. L. (cap. {V}) aceptaron la nota.|La parte subió de 3,{V} a 1.234,5 palabras aprox. en total.|Il dott. K. e la sig.ra L. (cap. {V}) hanno accettato la nota.|Dr. K. en mevr. L. keurden d.w.z. alleen noot {V} goed.|O Dr. K. e a Sra. L. (cap. {V}) aceitaram a nota.|А. К. и др. рецензенты согласились с правкой № {V}!|Nasza grupa robocza sprawdziła tabelę z wynikami (por. s. {V}).
no|The committee restored the caption of figure {V} in the second draft.|A later comment moved the reader’s objection while the tracked changes were open.|Nobody in the team kept the old heading.[^{V}]|委员会在第{V}版里删除了第一句话。|翻訳者は第{V}版で結果の表を残した。|## Verdict|- Our working group kept it before the deadline|{V}. The appendix renumbered two long sentences.|[^{V}]: The translator checked the section on method.|> The co-author quoted the table of results.
"""
ADDRESSES = {
    "en": ["{n} {P} {S}, {T}", "{n} {P} Blvd, Apt {a}, {T} {z}", "Flat {a}, {n} {P} Row, {T} {q}", "{n} {P} {S}, {T} {q}"],
    "de": ["{D} {n}, {z} {T}", "{D} {n}{l}, {T}", "{D} {n}, {T}"],
    "fr": ["{a} bis avenue {F}, {T}", "{n} bis avenue {F}, {T}", "{a} bis rue {F}, {T}", "{n}, rue {F}, {z} {T}", "{n} rue {F}, {T}"],
    "es": ["Calle {G}, {a}, {m}.º B, {z} {T}", "Calle {G}, {n}, {m}.º A, {z} {T}", "Calle {H}, {a}, {m}.º C, {z} {T}", "C/ {G} {n}, {T}", "Avenida {G} {n}, {z} {T}"],
    "it": ["P.zza {G}, {n}, {T}", "Via {H} {n}, {z} {T}", "Piazza {H} {n}, {T}", "Via {H} {n}, {T}"],
    "pt": ["Av. {H} {n}, {T}", "Av. {H} {n}, {z} {T}", "Rua {F2}, {n}, {z} {T}", "Rua {F2} {n}, {T}"],
    "nl": ["{L} {n}, {z} {T}", "{L} {n}{l}, {T}"],
    "pl": ["ul. {H} {n}, {z} {T}", "{n} {P} Blvd, Apt {a}, {T} {z}"],
}
# Names of streets, towns and persons as they are common in several countries; none is taken from any test text.
PLACES = "Oak Elm Cedar Park Church Hill Lake Spring Sunset Victoria King Queen Bridge Garden Castle Market Meadow Forest Rose_Hill Old_Mill".split()
KINDS = "Ave. Street Lane Close Road Avenue Row Way Terrace Drive Square".split()
STREETS = "Schulstraße Bergstraße Gartenweg Waldweg Rosengasse Kaiserplatz Goethestr. Ringstraße Lindenallee Am_Alten_Markt An_der_Kirche Im_Tal Brunnengasse Schlossplatz Wiesenweg".split()
TOWNS = [a + b for a in ("Nor", "Kel", "Ash", "Wald", "Stein", "Villa", "Ober", "Lang", "Dal", "Sund", "Mar", "Bel") for b in ("field", "burg", "berg", "ville", "ton", "stadt", "ham", "dorf", "bury", "vik", "rino", "anova")]
GIVEN = """James Mary John Patricia Robert Jennifer Oliver Emma Noah Sophie Lukas Hannah Felix Lena Hugo Chloé Louis Camille Mateo Lucía Pablo Sofía Luca Giulia Matteo Chiara Tiago Inês Rui Daan Sanne Bram Femke Erik Astrid Lars Karin
Jakub Kasia Piotr Ola Mehmet Ayşe Yusuf Zeynep Omar Fatima Hassan Layla Arjun Priya Ravi Anjali Kofi Ama Tunde Ngozi Yuki Haruto Ming Mei Minh Linh Anna Paul Julia Thomas Maria Peter""".split()
CYRILLIC = "Иван Мария Олег Анна Сергей Елена Дмитрий Ольга Андрей Наталья Тарас Оксана Богдан Ирина Павел Юлия".split()
CYRILLIC_LAST = "Иван Петр Смирн Кузнец Сокол Попов Лебед Козл Новик Мороз Волк Зайц Павл Семен Голуб Бондар".split()
HAN, HAN_GIVEN = "王李张刘陈杨赵黄周吴徐孙马朱胡林郭何高罗郑梁谢宋唐许韩冯邓曹彭曾田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢", "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超霞平刚桂华飞玉萍红鹏浩宇轩然子涵欣怡雨晨佳思文志建国海云天宏博雅琳雪梅兰峰龙斌"
JA_LAST = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 松本 井上 木村 斎藤 清水 森 池田 橋本 石川 前田 長谷川 竹ノ内".split()
JA_GIVEN = "太郎 花子 由美 健 翔 大輔 美咲 陽菜 蓮 結衣 直樹 恵子 拓也 和子 誠 裕子 浩二 真由美 亮 千尋".split()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _surname(r: random.Random) -> str:
    if r.random() < 0.4:
        return _syllables(r, "n r l s t nd rt ck x m sh th")
    s = "".join(r.choice(["b", "d", "dr", "f", "g", "gl", "k", "kr", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "h"]) + r.choice("aeiou") + r.choice(["", "", "l", "r", "n", "s"]) for _ in range(r.choice([1, 2, 2, 3])))
    return (s + r.choice("ski mann son ez er o a ov ini etti ard eau el in ic ak as ou dal berg stein ton ley sen ström ez es an u".split())).capitalize()


def _syllables(r: random.Random, ends: str) -> str:
    """An invented word, so that words nobody listed are learnt by their shape and place."""
    s = "".join(r.choice("b c d f g h j k l m n p r s t v w z br dr gr kl pr st th tr ch sh".split()) + r.choice(["a", "e", "i", "o", "u", "a", "e", "ö", "é", "á", "ai", "ou"]) for _ in range(r.choice([1, 2, 2, 3])))
    return (s + r.choice(ends.split())).capitalize()


def _given(r: random.Random) -> str:
    return r.choice(GIVEN) if r.random() < 0.25 else _syllables(r, "n na s la ne r t lia nd ka o a rd l nn x ine tha bert gard")


def _town(r: random.Random) -> str:
    return r.choice(TOWNS) if r.random() < 0.3 else _syllables(r, "heim wick ford lara ine mouth stad ona burg ton ville dorf ia ow ingen hafen minster aux ano")


def _place(r: random.Random) -> str:
    return r.choice(PLACES).replace("_", " ") if r.random() < 0.6 else _syllables(r, "er y ow le t nd ll th ck ch rn")


def _han(r: random.Random, n: int) -> str:
    """Characters at random: names hold any."""
    return "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n))


def name(r: random.Random, lang: str) -> str:
    if lang in ("ru", "uk") and r.random() < 0.6 or lang == "xx" and r.random() < 0.12:
        return f"{r.choice(CYRILLIC)} {r.choice(CYRILLIC_LAST)}{r.choice(['ич', 'енко', 'ун', 'ов', 'ейчук', 'атич', 'атенко', 'як', 'чук', 'ко', 'ский', 'ин'])}"
    if lang == "zh" and r.random() < 0.6 or lang == "xx" and r.random() < 0.2:
        n = r.choice([1, 2, 2, 2])
        return (r.choice(HAN) if r.random() < 0.5 else _han(r, 1)) + ("".join(r.choice(HAN_GIVEN) for _ in range(n)) if r.random() < 0.4 else _han(r, n))
    if lang == "ja" and r.random() < 0.6 or lang == "xx" and r.random() < 0.15:
        last = r.choice(JA_LAST) if r.random() < 0.4 else _han(r, 1) + r.choice(["", "ノ", "ヶ", "乃", "々"]) + _han(r, r.choice([1, 1, 2]))
        return f"{last} {r.choice(JA_GIVEN) if r.random() < 0.4 else _han(r, r.choice([1, 2, 2]))}"
    g, s = _given(r), _surname(r)
    if r.random() < 0.15:
        s += "-" + _surname(r)
    if r.random() < 0.25:
        s = r.choice(["von", "de", "van der", "van"]) + " " + s
    kind = r.random()
    if kind < 0.5:
        return f"{g} {s}"
    if kind < 0.62:
        return f"{g} {r.choice('ABEHKMTJLR')}. {s}"
    if kind < 0.76:
        return f"{r.choice('ABCDEFGHIJKLMNOPQRSTUVWZ')}. {s}"
    if kind < 0.88:
        return f"{s}, {g}"
    return f"{g} {s}".upper()


def email(r: random.Random) -> str:
    at, dot = r.choice([("@", ".")] * 6 + [("[at]", "."), (" (at) ", " (dot) "), ("[at]", "[dot]")])
    local = r.choice([f"{_given(r)}.{_surname(r)}", f"{_surname(r).lower()}_{_digits(r, 2)}", f"{r.choice('bgjmn')}{_surname(r).lower()}", f"{r.choice(GIVEN).lower()}+news", f"{_surname(r).lower()}-{r.choice(GIVEN).lower()}"])
    host = r.choice([_surname(r).lower(), f"mail{dot}{_surname(r).lower()}", f"uni-{_surname(r).lower()}", _surname(r).upper(), "web"])
    return local + at + host + dot + r.choice(["com", "org", "net", "edu", "eu", "example", "COM"])


def _filled(r: random.Random, pattern: str) -> str:
    """A number by pattern: ``9`` a digit, ``1`` one that isn't 0, ``A`` a letter; as it stands otherwise."""
    return "".join(r.choice("0123456789") if c == "9" else r.choice("123456789") if c == "1" else r.choice("ABCDEFGHJKLMNPRSTWXYZ") if c == "A" else c for c in pattern)


# How telephone numbers are written in several countries.
PHONES = """+1-199-199-9999|+1 (199) 199-9999|(199) 199-9999|199-199-9999|199.199.9999|001 199 199 9999|+44 1199 999 999|+44 (0)1199 999999|01199 999999|(01199) 999999|01199 999 999|+49 19 99999999|+49 199 9999999|0049 19 99999 999|019 99999 999|019/99999-999
01 99 99 99 99|01.99.99.99.99|+33 1 99 99 99 99|0033 1 99 99 99 99|199 999 999|+34 199 99 99 99|+34 199 999 999|+39 019 9999999|019 9999999|019/9999999|+39 099 9999999|+351 199 999 999|+199 999 999 999|+31 19 999 9999|+48 199 999 999|+7 199 999-99-99|+81 19 9999 9999|+86 199 9999 9999|000 9999999""".replace("\n", "|").split("|")
# How numbers of insurance, tax, passports and identity cards are written in several countries.
IDENTITIES = """999-99-9999|999 99 9999|999-00-9999|AA 99 99 99 A|AA999999A|AA9999999|A99999999|999999999|099999999|000099999|99 999 999 999|00 999 999 999|99999999999|00999999999|99/999/99999|00/999/99999|1 99 99 99 999 999 99|0 99 99 99 999 999 99|199999999999999|099999999999999
99999999A|00999999A|99999999-A|00999999-A|99.999.999-A|00.999.999-A|AAAAAA99A99A999A|AAAAAA99A99A999A|AAA999999|9999 999999""".replace("\n", "|").split("|")


def phone(r: random.Random) -> str:
    return _filled(r, r.choice(PHONES))


def identity(r: random.Random) -> str:
    return _filled(r, r.choice(IDENTITIES))


def address(r: random.Random, lang: str) -> str:
    lang = lang if lang in ADDRESSES else r.choice(["en", "en", "de", "fr"]) if lang == "xx" else "en"
    names = ["San Juan", "del Sol", "de la Paz", "Mayor", "Garibaldi", "della Repubblica", "do Carmo"]
    of = lambda *own: r.choice(own) if r.random() < 0.5 else r.choice(["de la ", "des ", "du ", "del ", "do ", "das ", ""]) + _syllables(r, "s rs ne lle nte ro ra os res lin")
    return r.choice(ADDRESSES[lang]).format(
        n=r.randint(1, 3999) if r.random() < 0.4 else r.randint(1, 150), P=_place(r), S=r.choice(KINDS), a=r.randint(1, 60), m=r.randint(1, 9), l=r.choice("abc"), T=_town(r), z=_digits(r, 5), q=_filled(r, r.choice(["AA1 9AA", "A19 9AA", "AA19 9AA"])), D=r.choice(STREETS).replace("_", " ") if r.random() < 0.6 else _syllables(r, "weg gasse straße platz str. allee ufer"), L=r.choice(["Stationsstraat", "Schoolweg", "Beatrixlaan", "Nieuwegracht", "Dorpsplein"]),
        F=of("de la République", "des Lilas", "du Général Leclerc", "de l’Église", "Pasteur"), F2=of("da Liberdade", "das Oliveiras", "do Comércio", "de Santo António"), G=of(*names), H=of("Augusta", "Verdi", "Milano", "del Corso", "Krótka"),
    )


def rows(seed: int = 11, times: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    r = random.Random(seed)
    out = []
    fill = {"N": ("name", name), "E": ("email", lambda r, _: email(r)), "P": ("phone", lambda r, _: phone(r)), "I": ("id_number", lambda r, _: identity(r)), "A": ("address", address)}
    plain = {"V": lambda: _digits(r, 2), "W": lambda: _surname(r).lower()}
    for line in SENTENCES.strip().split("\n"):
        lang, _, rest = line.partition("|")
        for sentence in re.split(r"(?<! )\|(?! )", rest):
            sentence = sentence.replace("⏎", "\n")
            for _ in range((4 if lang == "no" else times) * (6 if sentence.startswith("-- ") or (lang in ("zh", "ja") and "{N}" in sentence) else 3 if "{N}" in sentence else 3 if "{A}" in sentence else 1)):
                text, spans = "", []
                for part in re.split(r"(\{[NEPIAVW]\})", sentence):
                    if re.fullmatch(r"\{[NEPIAVW]\}", part):
                        k = part[1]
                        if k in plain:
                            text += plain[k]()
                        else:
                            kind, make = fill[k]
                            v = make(r, lang)
                            spans.append((len(text), len(text) + len(v), kind))
                            text += v
                    else:
                        text += part.replace("{{", "{").replace("}}", "}")
                out.append((text, spans))
    return out
