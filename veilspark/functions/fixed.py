"""Entity catalogue, vocabularies and the field grammars that results depend on.

Grammars are in Java's dialect. ``(?U)`` gives classes, word boundaries and case folding their Unicode meaning, ``(?d)``
makes the line feed the only line end.
"""

# --- fixed values: entity catalogue --------------------------------------------------------------------------------
# type, placeholder, singular, plural, category, priority, checksum mark
ENTITIES = [
    ("PEC_ADDRESS", "PEC", "PEC", "PEC", "Contatti", 8, False),
    ("EMAIL_ADDRESS", "EMAIL", "email", "email", "Contatti", 7, False),
    ("PHONE_NUMBER", "TELEFONO", "telefono", "telefoni", "Contatti", 7, False),
    ("CODICE_FISCALE", "CODICE_FISCALE", "codice fiscale", "codici fiscali", "Documenti", 7, True),
    ("PARTITA_IVA", "PARTITA_IVA", "partita IVA", "partite IVA", "Documenti", 7, True),
    ("IBAN", "IBAN", "IBAN", "IBAN", "Finanziari", 7, True),
    ("SDI_CODE", "CODICE_SDI", "codice SDI", "codici SDI", "Finanziari", 7, False),
    ("HEALTH_CARD", "TESSERA_SANITARIA", "tessera sanitaria", "tessere sanitarie", "Documenti", 7, True),
    ("IDENTITY_DOCUMENT", "DOCUMENTO_IDENTITA", "documento d'identità", "documenti d'identità", "Documenti", 7, False),
    ("VEHICLE_PLATE", "TARGA_VEICOLO", "targa veicolo", "targhe veicolo", "Documenti", 7, False),
    ("PROTOCOL_CASE_NUMBER", "PROTOCOLLO_PRATICA", "numero protocollo/pratica", "numeri protocollo/pratica", "Documenti", 7, False),
    ("CATASTO", "DATO_CATASTALE", "dato catastale", "dati catastali", "Documenti", 7, False),
    ("POSTAL_CODE", "CAP", "CAP", "CAP", "Luoghi", 7, False),
    ("CREDIT_CARD", "CARTA_PAGAMENTO", "carta di pagamento", "carte di pagamento", "Finanziari", 6, True),
    ("ORGANIZATION", "ORGANIZZAZIONE", "organizzazione", "organizzazioni", "Enti", 6, False),
    ("TERRITORIAL_BODY", "ENTE_TERRITORIALE", "ente territoriale", "enti territoriali", "Enti", 6, False),
    ("LOCATION", "LOCALITA", "località", "località", "Luoghi", 5, False),
    ("PERSON", "PERSONA", "persona", "persone", "Persone", 5, False),
    ("ADDRESS", "INDIRIZZO", "indirizzo", "indirizzi", "Luoghi", 4, False),
    ("DATE", "DATA", "data", "date", "Date", 3, False),
]
OTHER_CATEGORY = "Altro"
NO_INITIALS = "<ANONIMIZZATO>"

# --- fixed values: report wording ----------------------------------------------------------------------------------
MODE_LABELS = {"standard": "Standard", "maximum": "Massima protezione", "reversible": "Reversibile"}
MODE_NOTES = {
    "standard": "Standard mantiene leggibili struttura e contesto, conservando iniziali e date. Per documenti ad alto rischio valuta Massima protezione.",
    "maximum": "Massima protezione usa segnaposto completi e redige anche date comuni riconosciute.",
    "reversible": "Sostituisce i dati con etichette come <PERSONA_1>. Al termine salverai un File di ripristino cifrato, necessario per reinserire i dati nella risposta dell’IA.",
}
REVIEW_NOTE = "Rileggi sempre il risultato prima di condividerlo."
NOTHING_FOUND = "nessun dato riconosciuto"
CHECKLIST_BY_MODE = {
    "maximum": "Massima protezione è consigliata prima di condividere testi con chatbot o servizi esterni.",
    "reversible": "Reversibile è pensata per lavorare con l’IA: salva il File di ripristino e non condividerlo con servizi esterni.",
    "standard": "Standard mantiene più contesto: controlla con attenzione iniziali, date e dettagli che potrebbero identificare persone.",
}
CHECKLIST_FOUND = "Controlla se nel testo restano nomi, luoghi o dettagli identificativi non evidenziati."
CHECKLIST_EMPTY = "Nessun dato riconosciuto non significa anonimizzazione garantita: rileggi il testo con attenzione."
SOURCE_LABELS = {
    "italian_rules": "Regole italiane locali",
    "location_dictionary": "Elenco località italiane (ISTAT)",
    "name_dictionary": "Dizionario nomi italiani",
    "ner_local": "NER locale (spaCy)",
    "surname_first_rule": "Cognome e nome in elenchi",
    "coreference": "Propagazione nome",
    "manual": "Aggiunto manualmente",
}

# --- fixed values: labels of the activity log ---------------------------------------------------------------------
LOG_ACTIONS = {"analysis": "Analisi", "anonymization": "Anonimizzazione", "save": "Salvataggio"}
LOG_SOURCES = {"document": "Documento", "pasted_text": "Testo incollato"}

# --- fixed values: OOXML names that hold text or persons -------------------------------------------------------------
DOCX_TEXT_NODES = ("t", "delText", "instrText")
DOCX_PERSONAL_ATTRIBUTES = ("author", "initials", "lastModifiedBy")
DOCX_NAMING_ATTRIBUTES = ("name", "linkTarget")

# --- fixed values: IBAN lengths of the public registry -------------------------------------------------------------
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# --- fixed values: check-letter weights of fiscal codes (digits 0-9, then letters A-Z) -----------------------------
FISCAL_ODD_DIGITS = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21]
FISCAL_ODD_LETTERS = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]

# --- fixed values: vocabularies ------------------------------------------------------------------------------------
PEC_DOMAINS = "arubapec.it legalmail.it messaggipec.it pecimprese.it postacertificata.gov.it registerpec.it sicurezzapostale.it".split()
PEC_SUFFIXES = (".legalmail.it", ".postacertificata.gov.it")
MONTHS = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split()
LOWER_STREET_STOP = (
    "email e-mail mail pec fax sms telefono telematica posta preliminare gradata definitiva ordinaria breve libera eccezionale prioritaria "
    "entro il lo la i gli le un uno una al allo alla ai agli alle per con presso ogni senza che numero corriere"
).split()
PERSON_STOP = "Premesso Contratto Societa Società Impresa Azienda Ditta Cliente Referente Rappresentante Sottoscritto Sottoscritta Nato Nata".split()
CITY_STOP = "Euro Eur Dollari Sterline Franchi Iva Netti Lordi Abitanti Unita Unità Notaio Notaia Repertorio Raccolta".split()
SURNAME_STOP = "Comune Comuni Provincia Regione Località Frazione San Santa Presidente Sindaco Comando Corpo Ufficio Ditta".split()
NOT_A_SURNAME = (
    "via viale piazza piazzale corso largo vicolo strada contrada localita località frazione provincia regione comune municipio "
    "sig sigra signora signor dott dottssa avv ing geom rag prof profssa sottoscritto sottoscritta cliente referente rappresentante titolare "
    "nato nata intestatario intestataria beneficiario beneficiaria notaio notaia srl spa snc sas soccoop cooperativa onlus aps ets "
    "ditta societa società impresa azienda denominazione"
).split()
BARE_COMPANY_WORDS = "società societa impresa azienda ditta cooperativa".split()
NEVER_A_PLACE = ("comparsa", "note")
MODEL_PLACE_REJECTS = ("collegio", "euro", "parte venditrice", "provincia", "province")

# --- fixed values: character classes and words ---------------------------------------------------------------------
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
UPPER = "A-ZÀ-ÖØ-Þ"
LOWER = "a-zà-öø-ÿ"
STREETS = "Via|Viale|Piazza|Piazzale|Corso|Largo|Vicolo|Strada|Contrada|Località|Localita|Frazione"
CAP = f"[{UPPER}][{LETTERS}'’.-]+"
NAME = rf"(?!(?:{STREETS})\b){CAP}"
UPPER_NAME = f"[{UPPER}]{{2,}}(?:['’.-][{UPPER}]{{1,}})*"
BODY_WORD = rf"(?:[{UPPER}]\.|[{UPPER}][{LETTERS}'’]*(?:-[{UPPER}]?[{LETTERS}'’]+)*)"
ACADEMIC_WORD = rf"(?!(?i:Universit[aà]|Dipartimento)\b){BODY_WORD}"
FIRM_WORD = f"(?:[{UPPER}0-9][{LETTERS}0-9&'’.-]*|[A-Z0-9&]{{2,}}|&)"
FIRM_NAME_WORD = f"(?:[{UPPER}][{LETTERS}&'’-]*|[A-Z0-9&]{{2,}}|&)"
FIRM_LINK = "(?i:di|del|dello|della|dei|degli|delle|da|dal|dalla|e)"
NO_FIELD = r"(?!(?i:p\.?[ \t]*iva|c\.?[ \t]*f\.?|iban|pec|e-?mail|tel\.?|telefono)\b)"
LEGAL_FORM = r"(?i:s\.?[ \t]*r\.?[ \t]*l\.?|s\.?[ \t]*p\.?[ \t]*a\.?|s\.?[ \t]*n\.?[ \t]*c\.?|s\.?[ \t]*a\.?[ \t]*s\.?|soc\.?[ \t]*coop\.?|cooperativa|onlus|aps|ets|s\.?[ \t]*s\.?)"
OF = "di|del|della|dei|degli|delle"
TITLES = r"sig\.?\s*ra\.?|sig\.?|signora?|dott\.?\s*ssa\.?|dott\.?|avv\.?|ing\.?|geom\.?|rag\.?|prof\.?\s*ssa\.?|prof\.?|notaio|notaia"
MAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PLACE_WORD = f"[{UPPER}][{LETTERS}'’.-]*"
PLACE = rf"{PLACE_WORD}(?:[ \t]+(?:(?:{OF}|d['’])[ \t]+)?{PLACE_WORD}){{0,3}}"
PLACE_GAP = r"[ \t]*[,;/][ \t]*|[ \t]+e[ \t]+"

# --- fixed values: field grammars (the value group, where there is one, ends the match) ---------------------------
EMAIL = rf"(?iU)\b{MAIL}\b"
PEC_LABELLED = rf"(?iU)\b(?:pec|posta\s+elettronica\s+certificata|domicilio\s+digitale)\s*(?:n\.?|num\.?|nr\.?|indirizzo|email|e-mail)?\s*[:#-]?\s*({MAIL})\b"
PHONE = r"(?U)(?<!\w)(?:\+39[\s./-]?)?(?:3[0-9]{2}|0[0-9]{1,4})[\s./-]?[0-9]{3,4}[\s./-]?[0-9]{3,4}(?!\w)"
FOREIGN_PHONE = r"(?U)(?<![\w+])\+(?!39\b)[1-9][0-9]{0,2}(?:[\s./-]?\(?[0-9]{1,4}\)?){2,5}(?!\w)"
FISCAL_SHAPE = "[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]"
FISCAL = rf"(?iU)\b{FISCAL_SHAPE}\b"
FISCAL_LABELLED = r"(?U)(?i:c\.?\s*f\.?|cod(?:ice)?\.?\s*fisc(?:ale)?\.?)[\s:.\-]*([A-Z0-9](?:\s*[A-Z0-9]){15})\b"
FISCAL_HEADER = r"(?i:c\.?[ \t]*f\.?|codice[ \t]+fiscale)"
VAT = r"(?iU)\b(?:IT[\s-]?)?([0-9]{11})\b"
IBAN_HEAD = r"(?iU)\b[A-Z]{2}[\s-]*[0-9]{2}"
IBAN_WHOLE = r"(?iU)^[A-Z]{2}[\s-]*[0-9]{2}(?:[\s-]*[A-Z0-9]){11,30}\b"
SDI = r"(?iU)\b(?:codice\s+(?:destinatario(?:\s+sdi)?|sdi|univoco(?:\s+ufficio)?)|cod\.?\s*(?:destinatario|sdi|univoco)|sdi)\s*(?:n\.?|num\.?|nr\.?|numero|cod\.?)?\s*[:#-]?\s*([A-Z0-9]{6,7})\b"
HEALTH_CARD = r"(?iU)\b(?:(?:(?:numero|codice|cod\.?)\s+(?:della\s+)?)?tessera\s+sanitaria|ts[\s-]*cns|carta\s+nazionale\s+dei\s+servizi)\s*(?:n\.?|num\.?|nr\.?|numero|codice|cod\.?)?\s*[:#-]?\s*((?:\d[\s.-]?){19}\d)\b"
IDENTITY = r"(?iU)\b(?:carta\s+d['’]?\s*identit[aà]|carta\s+identit[aà]|documento\s+d['’]?\s*identit[aà]|documento\s+identit[aà]|passaporto|patente|c\.?\s*i\.?)\s*(?:n\.?|num\.?|nr\.?|numero)?\s*[:#-]?\s*([A-Z]{1,3}[\s.-]?\d{4,8}[\s.-]?[A-Z]{0,3}|\d{6,10})\b"
PLATE = r"(?iU)\b(?:targa(?:\s+(?:veicolo|auto|autovettura|mezzo|automezzo|aziendale)){0,3}|targato|targata|veicolo\s+targato|auto\s+targata|autovettura\s+targata)\s*(?:n\.?|num\.?|nr\.?|numero)?\s*[:#-]?\s*([A-Z]{2}\s*\d{3}\s*[A-Z]{2}|[A-Z]{1,2}\s*\d{5,6}|[A-Z]{2}\s*\d{5})\b"
PROTOCOL = r"(?iU)\b(?:numero\s+(?:di\s+)?protocollo|protocollo(?:\s+informatico)?|prot\.?|numero\s+(?:di\s+)?pratica|pratica|fascicolo|istanza|domanda|richiesta)(?:\s+(?:n\.?|num\.?|nr\.?|numero|cod\.?|codice|id))?\s*[:#-]?\s*((?:[A-Z]{1,5}\s+)?[A-Z0-9]{2,}(?:\s*[./-]\s*[A-Z0-9]{1,10}){0,4})\b"
CADASTRE = r"(?iU)(?<!\w)(foglio(?:\s+catastale)?|fgl\.?|fg\.?|particell[ae](?:\s+catastal[ei])?|part\.?|p\.?\s*lla\.?|mappal[ei](?:\s+catastal[ei])?|mapp\.?|subaltern[oi]|sub\.?|sezione(?:\s+urbana)?|sez\.?|categoria\s+catastale|cat\.?\s*cat\.?)(?!\w)\s*(?:n\.?|num\.?|nr\.?|numero)?\s*[:#=-]?\s*([A-Z0-9]{1,8}(?:\s*[/\-]\s*[A-Z0-9]{1,8}|\.\d{1,8}){0,2})(?!\w)"
CADASTRE_STRONG = r"^(?:particell.*|plla|mappal.*|mapp|subaltern.*|sub|categoriacatastale.*|catcat)$"
CADASTRE_DOMAIN = r"(?iU)catast|n\.?\s*c\.?\s*e\.?\s*u\.?|n\.?\s*c\.?\s*t\.?|immobil|unit[aà]\s+immobiliar|terren|fabbricat"
CARD = r"(?U)(?<![\w-])(?!0)\d(?:[ -]?\d){12,18}(?![\w-])"
ADDRESS = (
    r"(?U)\b(?i:via|v\.|viale|v\.le|piazza|p\.zza|piazzale|corso|c\.so|vicolo|largo|strada|contrada|localit[aà]|loc\.|frazione)[ \t]+"
    rf"(?:(?i:di|del|dello|della|dei|degli|delle)[ \t]+|(?i:dell['’]))?(?:{CAP}|[A-Z0-9]{{1,5}})(?:[ \t]+(?:{CAP}|[{LOWER}]{{2,}}|[A-Z0-9]{{1,5}})){{0,7}}"
    rf"(?:[ \t]*,?[ \t]+\d{{1,4}}(?![0-9])[A-Za-z]?)?(?:[ \t]*,?[ \t]*(?:\d{{5}}[ \t]+)?{CAP}(?:[ \t]+{CAP}){{0,2}})?"
)
ADDRESS_NOT_VIA = r"(?iU)^via\s+(?:pec\b|p\.?\s*e\.?\s*c\.?(?=\s|$|[,;:])|email\b|e-mail\b|mail\b|fax\b|sms\b|telefono\b|telematica\b|corriere\b|preliminare\b|gradata\b)"
ADDRESS_NOT_CORSO = r"(?iU)^corso\s+(?:di\s+)?(?:laurea|studi|formazione|economia|giurisprudenza|medicina|ingegneria|informatica)\b"
ADDRESS_HAMLET = r"(?iU)^(?:localit[aà]|frazione)\b"
LOWER_ADDRESS = (
    r"(?U)\b(?:via|viale|piazza|piazzale|corso|vicolo|largo|strada|contrada|frazione|località|localita)[ \t]+"
    rf"([{LOWER}]{{2,}}(?:[ \t]+[{LOWER}]{{2,}}){{0,3}})[ \t]*,?[ \t]+n?\.?[ \t]*\d{{1,4}}(?:[ \t]*/[ \t]*[A-Za-z]|[A-Za-z])?\b"
)
POSTCODE_CITY = r"(?U)(?<![\w-])\d{5}[ \t]+([A-ZÀ-Ù][a-zà-ù]+(?:[ \t]+[A-ZÀ-Ù][a-zà-ù]+){0,3})\b"
POSTCODE_REGISTER = r"(?iUd)\b(?:repertorio|rep\.?|raccolta)(?:\s+(?:n\.?|num\.?|numero))?\s*[:#;,.\-=]?\s*$"
POSTCODE_LABELLED = r"(?U)\b(?i:cap|c\.?\s*a\.?\s*p\.?|codice\s+postale|codice(?:\s+di)?\s+avviamento\s+postale)\s*(?:n\.?|numero)?\s*[:#;,\-=]?\s*(\d{5})(?!\d)"
FIRM_SUFFIX = rf"(?U)\b{FIRM_WORD}(?:[ \t]+(?:{FIRM_WORD}|{FIRM_LINK})){{0,7}}[ \t]+{LEGAL_FORM}(?!\w)"
FIRM_PREFIX = (
    r"(?U)\b(?i:ditta(?:\s+individuale)?|societ[aà]|impresa|azienda|ragione\s+sociale|denominazione|cooperativa)"
    rf"\s+{NO_FIELD}{FIRM_NAME_WORD}(?:[ \t]+{NO_FIELD}(?:{FIRM_NAME_WORD}|{FIRM_LINK})){{0,6}}(?:[ \t]+{LEGAL_FORM})?(?![.\w])"
)
FIRM_BROKEN = rf"(?U)\b({FIRM_WORD}(?:[ \t]+{FIRM_WORD}){{0,5}})[ \t]*-[ \t]*(?:S\.[ \t]*)?((?i:s\.[ \t]*r\.[ \t]*l\.?))"
FIRM_MARK = r"(?U)\b(?:s\.?\s*r\.?\s*l\.?|s\.?\s*p\.?\s*a\.?|s\.?\s*n\.?\s*c\.?|s\.?\s*a\.?\s*s\.?|soc\.?\s*coop\.?|cooperativa|onlus|aps|ets|s\.?\s*s\.?)\b"
FIRM_START = r"(?U)^(?:ditta|societ[aà]|impresa|azienda|ragione sociale|denominazione|cooperativa)\b"
ACADEMIC = rf"(?U)\b((?i:universit[aà](?:[ \t]+degli[ \t]+studi)?|dipartimento))([ \t]+(?i:{OF})[ \t]+)({ACADEMIC_WORD}(?:[ \t]+{ACADEMIC_WORD}){{0,5}})"
BODY = (
    r"(?U)\b((?i:provincia|regione|comune|citt[aà]\s+metropolitana|municipio|unione\s+dei\s+comuni|comunit[aà]\s+montana|amministrazione\s+(?:provinciale|comunale|regionale)"
    rf"|prefettura|questura|procura(?:\s+della\s+repubblica)?|tribunale|camera\s+di\s+commercio))(\s+(?:(?i:{OF})\s+)?)({BODY_WORD}(?:\s+{BODY_WORD}){{0,4}})"
)
PERSON_TITLED = (
    r"(?U)\b(?:(?:il|la)\s+)?(?i:sig\.?ra|sig\.?|signora|signor|dott\.?ssa|dott\.?|avv\.?|ing\.?|geom\.?|rag\.?|prof\.?ssa|prof\.?|notaio|notaia|sottoscritto|sottoscritta|cliente|referente"
    rf"|rappresentante|titolare|nato|nata|intestatario|intestataria|intestato\s+a|intestata\s+a|beneficiario|beneficiaria)\s+({NAME}(?:[ \t]+{NAME}){{1,3}})"
)
PERSON_BEFORE = rf"(?U)\b{NAME}(?:[ \t]+{NAME}){{1,3}}\b(?=\s*,?\s+(?i:nato|nata|residente|domiciliato|domiciliata|codice\s+fiscale|c\.?\s*f\.?|email|e-mail|pec|tel\.?|telefono|cell\.?|cellulare)\b)"
PERSON_CUT = r"(?U)\.(?=\s+(?i:allegat[oi])\b)"
NAME_TOKEN = rf"(?U)\b{NAME}\b"
NAME_RUN = rf"(?U)^{NAME}(?:[ \t]+{NAME}){{1,3}}\b"
AFTER_STREET = rf"(?iUd)(?:{STREETS})\s*$"
SURNAME_FIRST = rf"(?U)\b({UPPER_NAME}(?:[ \t]+{UPPER_NAME}){{0,2}})[ \t]+({NAME}(?:[ \t]+{NAME}){{0,2}})\b"
SURNAME_ROSTER = rf"(?U)\b({NAME})[ \t]+({NAME})\b"
ROSTER_BEFORE = r"(?iUd)(?:personale|dipendente|autista|conducente|operatore|agente|ispettore|responsabile|m\.?llo|np\.?|sc\.?|cl\.?)[^;\n]{0,48}$"
DATE = rf"(?U)(?<!\d)(?:[0-3]?\d)[/\-.](?:0?\d|1[0-2])[/\-.](?:\d{{2}}|\d{{4}})(?!\d)|(?<!\d)\d{{4}}-\d{{2}}-\d{{2}}(?!\d)|\b(?:[0-3]?\d)\s+(?i:{'|'.join(MONTHS)})\s+(?:\d{{2}}|\d{{4}})\b"
PLACE_TOKEN = rf"[{LETTERS}]+(?:['’/-][{LETTERS}]+)*"
PLACE_TEXT = rf"(?U)^[{LETTERS}'’/\-\s]+$"
PLACE_BEFORE = (
    r"(?iUd)\b(?:a|ad|in|da|dal|dalla|dai|dalle|presso|verso)\s+$",
    r"(?iUd)\bcorte(?:\s+di)?\s+appello(?:\s+di)?\s+$",
    r"(?iUd)\b(?:nato|nata|residente|domiciliato|domiciliata|vive|abitante|sede|luogo|localit[aà]|citt[aà]|comune|provincia|regione|territorio)(?:\s+(?:a|ad|in|di|nel|nella))?\s+$",
    r"(?iUd)\b(?:comuni?|localit[aà]|frazioni?|zone|territori)\b(?:[ \t]+(?:vigilat[ioe]|interessat[ioe]|coinvolt[ioe]|servit[ioe]))?[ \t]*[:\-–—]?[ \t]*$",
)
HAMLETS = rf"(?iU)\b(?:localit[aà]|frazione)[ \t]+({PLACE}(?:(?:{PLACE_GAP}){PLACE}){{0,5}})"
MUNICIPALITIES = rf"(?iU)\bcomuni?(?:[ \t]+(?:vigilat[ioe]|interessat[ioe]|coinvolt[ioe]|servit[ioe]))?[ \t]*:[ \t]*({PLACE}(?:(?:{PLACE_GAP}){PLACE}){{0,5}})"
ADDRESS_MARK = r"(?iU)\b(?:via|v\.|viale|v\.le|piazza|p\.zza|piazzale|corso|c\.so|vicolo|largo|strada|contrada|frazione)\b"
INSTITUTION_MARK = r"(?iU)\b(?:universit[aà]|dipartimento)\b"
NOT_PLACE_MARK = r"(?iU)\b(?:corpo|relazione|servizio|personale|ispettori|ufficio|comando|documento|fittizi)\b"
TITLE_MARK = rf"(?iU)\b(?:{TITLES})\b"
TITLE_BEFORE = rf"(?iUd)\b(?:{TITLES})\s*$"
LEGAL_PHRASE = r"(?U)\b(?:corte(?:\s+di)?\s+appello|giudice\s+(?:di\s+merito|delle\s+leggi)|comuni?\s+alle\s+province|difetto\s+di\s+motivazione|istituto\s+professionale|mancata\s+pronuncia|spetta\s+alle\s+regioni|autorità\s+giudiziaria)\b"
POTENZA_AFTER = r"(?iU)^\s+(?:di|del|dello|della|dei|degli|delle)\b"
NUMBERED = r"<([A-Z_]+)_(\d+)>"
PYTHON_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"

# --- fixed values: what text extracted from pages is cleaned of (pattern, new text), in this order -----------------
EXTRACTED_TEXT = [
    ("\u00ad", ""),
    ("\r\n|\r", "\n"),
    (rf"(?U)(?<=[{LETTERS}])-\s*\n\s*(?=[{LOWER}])", ""),
]
EXTRACTED_BREAK = r"(?U)\n\s*\n+"
EXTRACTED_PARAGRAPH = [
    (r"(?U)\s+([,.;:!?])", "$1"),
    (rf"(?U)(?<=[’'])\s+(?=[{LETTERS}])", ""),
]
