"""Patterns, word lists and tables that results depend on, stated as they are."""

# Entity patterns, in output order. Java syntax; (?U) gives Unicode classes.
ENTITY_PATTERNS = {
    "cpf": r"\b\d{3}[.\s]?\d{3}[.\s]?\d{3}[-.\s]?\d{2}\b",
    "phone": r"(?:\+?55\s?)?(?:\(?\d{2}\)?[\s.-]?)(?:9\d{4}|\d{4})[\s.-]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}\b",
    "url": r"""https?://[^\s<>"'\])}]+|www\.[^\s<>"'\])}]+""",
    "plate": r"(?i)\b[A-Z]{3}[-\s]?\d[A-Z0-9]\d{2}\b",
    "cnpj": r"\b\d{2}[./]?\d{3}[./]?\d{3}[/]?\d{4}[-]?\d{2}\b",
    "rg": r"\b\d{1,2}[./]?\d{3}[./]?\d{3}[-]?\d{1}\b",
    "pix_key": r"\b[0-9a-fA-F]{32}\b",
    "boleto": r"\b\d{12}\.\d{1}\s\d{11}\.\d{1}\s\d{11}\.\d{1}\s\d{11}\.\d{1}\s\d{1}\b|\b\d{47}\b",
    "bitcoin": r"\b(?:bc1|[13])[a-zA-HJ-NP-Z0-9]{25,62}\b",
    "bank_account": r"(?i)(?:ag(?:ência|encia)?[.:\s]*(\d{3,5}[-]?\d?))[^\d]+(?:conta[.:\s]*(\d{3,8}[-]?\d))",
}
# Weights of the two check digits of a CNPJ.
CNPJ_WEIGHTS = ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])

# Timestamp patterns of a text.
TIMESTAMP_PATTERNS = [
    r"\b\d{4}[-/]\d{2}[-/]\d{2}[\sT]\d{2}:\d{2}(?::\d{2})?\b",
    r"\b\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}(?::\d{2})?\b",
    r"\b\d{2}:\d{2}(?::\d{2})?\b",
    r"\b[A-Z][a-z]{2}\s+\d{1,2},?\s+\d{4}\b",
]
# Timestamp patterns of a surveillance recorder's overlay.
RECORDER_PATTERNS = [
    r"\b\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2}\b",
    r"\b\d{2}[-/]\d{2}[-/]\d{4}\s+\d{2}:\d{2}:\d{2}\b",
    r"\b\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}\b",
]
# Formats that a timestamp is parsed with.
TIMESTAMP_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm"]
# Formats of EXIF times.
EXIF_TIME_FORMATS = ["yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy:MM:dd HH:mm"]

# Keywords of document types, in order of precedence.
DOCUMENT_TYPES = {
    "rg": ["registro geral", "identidade", "rg ", "carteira de identidade"],
    "cpf": ["cadastro de pessoa", "cpf"],
    "cnpj": ["cnpj", "empresa", "razão social", "inscrição estadual"],
    "cnh": ["carteira de habilitação", "cnh", "habilitação"],
    "comprovante": ["comprovante", "recibo", "nota fiscal", "nf-e", "boleto", "linha digitável"],
    "contrato": ["contrato", "acordo", "termo de"],
    "screenshot": ["captura de tela", "screenshot", "print", "whatsapp", "telegram", "instagram"],
    "foto_documento": ["documento", "certidão", "alvará"],
    "foto_veiculo": ["placa", "veículo", "carro", "moto"],
    "foto_pessoa": ["pessoa", "indivíduo", "suspeito", "rosto"],
    "foto_local": ["local", "cena", "ambiente", "fachada"],
    "vigilancia": ["câmera", "camera", "cctv", "vigilância", "monitoramento", "dvr"],
    "criptomoeda": ["bitcoin", "btc", "carteira digital", "exchange", "cripto"],
}
# Keywords of threats, in order of precedence.
THREATS = {
    "phishing": ["phishing", "falso", "clique aqui", "senha", "atualizar cadastro", "urgente"],
    "fraude_financeira": ["pix", "transferência", "boleto falso", "código de barras", "qr code", "chave pix", "conta bancária", "agência", "saque", "depósito"],
    "ameaca": ["ameaça", "matar", "morrer", "vou te", "cuidado", "aviso"],
    "extorsao": ["extorsão", "pagar", "resgate", "vazamento", "nude", "íntim"],
    "falsificacao": ["falsificação", "adulterado", "manipulado", "editado", "photoshop", "montagem"],
    "estelionato": ["estelionato", "golpe", "pirâmide", "investimento falso", "lucro garantido"],
    "cyberbullying": ["bullying", "humilhação", "ofensa", "xingamento"],
    "drogas": ["droga", "maconha", "cocaína", "tráfico", "substância"],
    "armas": ["arma", "pistola", "revólver", "fuzil", "munição"],
    "lavagem": ["lavagem", "cripto", "bitcoin", "mixer", "tumbler", "exchange"],
}
# Keywords of context tags, in order.
CONTEXT_TAGS = {
    "financeiro": ["banco", "pix", "transferência", "dinheiro", "r$", "real", "pagamento"],
    "violencia": ["arma", "faca", "sangue", "ferimento", "agressão"],
    "digital": ["computador", "celular", "tela", "app", "site", "link"],
    "veicular": ["carro", "moto", "placa", "veículo", "trânsito"],
    "noturno": ["noite", "escuro", "madrugada", "iluminação artificial"],
    "residencial": ["casa", "apartamento", "residência", "condomínio"],
    "comercial": ["loja", "empresa", "escritório", "comércio"],
    "via_publica": ["rua", "avenida", "estrada", "calçada"],
}
# Words that say nothing about agreement; letters that words are made of.
STOPWORDS = ["que", "para", "com", "por", "uma", "dos", "das", "nos", "nas", "não", "mais", "como", "mas", "foi", "são", "tem", "ser", "ter", "está", "esta", "esse", "isso"]
WORD_LETTERS = "a-záàâãéèêíïóôõúüç"

# Repairs of broken encodings, in order.
REPAIRS = [
    ("Ã£", "ã"), ("Ã¡", "á"), ("Ã©", "é"), ("Ã­", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã§", "ç"), ("Ã¢", "â"), ("Ãª", "ê"), ("Ã´", "ô"),
    ("Ã", "à"), ("\x00", ""), ("�", ""), ("​", ""), ("‌", ""), ("﻿", ""), ("\xa0", " "),
]
# Marks of permanent errors in their texts.
PERMANENT_MARKERS = ["invalid_api_key", "incorrect api key", "authentication", "unauthorized", "permission_denied", "invalid_request_error", "model_not_found", "does not exist", "content_policy", "billing", "insufficient_quota"]
# HTTP statuses of permanent errors.
PERMANENT_STATUS = [400, 401, 403, 404, 405, 422]

# Names of editing software by a part of the EXIF value; the first match counts.
EDITORS = {
    "photoshop": "Adobe Photoshop", "gimp": "GIMP", "lightroom": "Adobe Lightroom", "snapseed": "Snapseed", "canva": "Canva", "pixlr": "Pixlr",
    "affinity": "Affinity Photo", "paint.net": "Paint.NET", "picsart": "PicsArt", "instagram": "Instagram", "whatsapp": "WhatsApp", "telegram": "Telegram",
}
# Parts of editors' names that weigh most.
CRITICAL_EDITORS = ["photoshop", "gimp", "affinity", "pixlr"]

# GPU memory in GB from which a model tier applies.
MEMORY_TIERS = [(3.5, "4gb"), (5.5, "6gb"), (7.5, "8gb"), (12.0, "16gb"), (20.0, "24gb"), (28.0, "32gb")]
# Steps of the chi-square p-value.
CHI_STEPS = [(16.27, 0.001), (11.34, 0.01), (7.815, 0.05), (6.25, 0.10)]
