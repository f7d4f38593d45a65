"""Closed sets and fixed tables of the span model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Labels, languages, thresholds, warnings and failures of the span model.
LABELS = ("account_number", "private_address", "private_date", "private_email", "private_person", "private_phone", "private_url", "secret")
LANGUAGES = ("en", "es", "pt")
APPLY_SCORE = 0.65
REPORT_SCORE = 0.15
MIN_TOKEN = 3
MAX_WORDS, OVERLAP_WORDS = 280, 24
TOKEN_BUDGET = 4096
PREVIEW = 80
MASK = "█"
ALIAS_WINDOW = 80
FILES_AT_MOST = 200
LEGIBLE_WORD, UNREADABLE_SHARE, LUMINANCE = 60, 0.25, 120
LAYER_WORDS = 12
SAME_LINE, COLUMN_GAP, BLOCK_GAP, BLEED = 0.6, 1.5, 1.2, 0.5
MIN_HITS, MIN_CONFIDENCE = 5, 0.5
WARNINGS = ("warning.droppedCharacters", "warning.lowConfidence", "warning.noText", "warning.notFullyRedacted", "warning.scannedPages")
FAILURES = ("failure.modelGone", "failure.modelSilent", "failure.modelUnreadable", "failure.unsupported", "failure.workerSilent")

# Field names of forms, by language and label, without marks or separators.
FIELD_NAMES = {
    "en": {
        "account_number": ("accountnumber", "bankaccount", "cardnumber", "creditcard", "iban", "passport", "passportnumber", "ssn", "taxid"),
        "private_address": ("address", "postalcode", "streetaddress", "zip", "zipcode"),
        "private_date": ("birthdate", "dateofbirth", "dob"),
        "private_email": ("email", "emailaddress", "mail"),
        "private_person": ("firstname", "fullname", "givenname", "lastname", "name", "surname", "username"),
        "private_phone": ("mobile", "phone", "phonenumber", "telephone", "whatsapp"),
        "private_url": ("profileurl", "website"),
        "secret": ("accesstoken", "apikey", "credential", "password", "secret", "token"),
    },
    "es": {
        "account_number": ("cuenta", "dni", "iban", "nie", "pasaporte", "tarjeta"),
        "private_address": ("codigopostal", "direccion"),
        "private_date": ("fechadenacimiento",),
        "private_email": ("correo", "email"),
        "private_person": ("apellido", "apellidos", "nombre", "nombrecompleto", "titular", "usuario"),
        "private_phone": ("celular", "movil", "telefono", "whatsapp"),
        "private_url": ("perfil",),
        "secret": ("contrasena",),
    },
    "pt": {
        "account_number": ("cartao", "cnh", "cnpj", "conta", "cpf", "iban", "passaporte", "rg"),
        "private_address": ("cep", "endereco", "logradouro"),
        "private_date": ("datadenascimento", "nascimento"),
        "private_email": ("correio", "email"),
        "private_person": ("nome", "nomecompleto", "sobrenome", "titular", "usuario"),
        "private_phone": ("celular", "telefone", "whatsapp"),
        "private_url": ("perfil",),
        "secret": ("senha",),
    },
}

# Words that tell languages apart, without marks.
STOPWORDS = {
    "en": ("and", "are", "at", "be", "but", "for", "from", "have", "in", "is", "it", "not", "of", "on", "that", "the", "they", "this", "to", "was", "with"),
    "es": ("del", "el", "ella", "ese", "esta", "este", "esto", "fecha", "firma", "fue", "hasta", "hay", "la", "las", "los", "muy", "nombre", "pero", "sus", "tambien", "una", "validez", "ya"),
    "pt": ("ao", "aos", "assinatura", "ate", "da", "das", "dos", "ela", "ele", "em", "emissao", "entao", "filiacao", "foi", "habilitacao", "isso", "ja", "muito", "nao", "nascimento", "nome", "numa", "pela", "pelo", "sao", "seu", "sua", "tambem", "uma", "validade", "voce"),
}
OCR_DATA = {"en": "eng", "es": "spa", "pt": "por"}

# File formats in order of precedence, with the type each extension implies.
FORMATS = (
    ("csv", ("text/csv",), {".csv": "text/csv"}),
    ("json", ("application/json",), {".json": "application/json"}),
    ("text", ("text/*",), {".log": "text/plain", ".md": "text/markdown", ".txt": "text/plain"}),
    ("pdf", ("application/pdf",), {".pdf": "application/pdf"}),
    ("image", ("image/*",), {".avif": "image/avif", ".bmp": "image/bmp", ".gif": "image/gif", ".heic": "image/heic", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".png": "image/png", ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp"}),
)
UNDECODABLE = (".heic", ".tif", ".tiff")

# Where each stage of a file's work begins on one bar from 0 to 1.
STRETCHES = ((0.0, ("stage.reading",)), (0.05, ("stage.extracting", "stage.rendering", "stage.recognising")), (0.3, ("stage.detecting",)), (0.5, ("stage.redacting", "stage.assembling")), (1.0, ("stage.finished",)))

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])


def field_labels() -> dict[str, str]:
    """Normalised field name -> label. A name that several languages share keeps the last one's label."""
    return {n: label for names in FIELD_NAMES.values() for label, own in names.items() for n in own}


def field_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(field_labels().items()), "field string, label string")


def stopword_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, lang) for lang, own in STOPWORDS.items() for w in own], "token string, language string")
