"""Word lists, patterns and formats that decide results.

Everything here is data a caller may replace; each operator takes its list as an argument.
"""

# --- fixed values: date formats, in the order they are tried -----------------------------

TABLE_DATE_FORMATS = [
    "yyyy-M-d", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy",
    "yyyy-M-d H:m:s", "M/d/yyyy H:m:s",
]
HISTORY_DATE_FORMATS = [
    "yyyy-M-d", "yyyy-M-d H:m:s", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.SSSSSS",
]
MESSAGE_DATE_FORMATS = ["d/M/yyyy", "yyyy-M-d", "M/d/yyyy", "d-M-yyyy"]
FIELD_DATE_FORMATS = [
    "d/M/yyyy", "yyyy-M-d", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d", "d.M.yyyy", "yyyy.M.d",
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
]
RECORD_DATE_FORMATS = [
    "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d", "d.M.yyyy", "yyyy.M.d",
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-M-d H:m:s", "d/M/yyyy H:m:s",
]

# --- fixed values: names that mark a column's role ---------------------------------------

DATE_NAME_PARTS = ["date", "time", "timestamp", "created", "updated"]
AMOUNT_NAMES = ["amount", "Amount", "transaction_amount", "value"]
MERCHANT_NAMES = ["payee", "Payee", "merchant", "Merchant", "description", "Description"]
WHEN_NAMES = ["date", "Date", "transaction_date", "timestamp", "Timestamp"]

# --- fixed values: characters ------------------------------------------------------------

INVISIBLE_CHARACTERS = "\u200e\u200f\u200b\u200c\u200d\ufeff"
ARABIC_DIGITS_AND_MARKS = "٠١٢٣٤٥٦٧٨٩٫٬"
WESTERN_DIGITS_AND_MARKS = "0123456789.,"

# --- fixed values: currencies ------------------------------------------------------------

CURRENCIES = [
    "EGP", "USD", "EUR", "GBP", "SAR", "AED", "KWD", "QAR", "BHD", "OMR",
    "JOD", "LBP", "IQD", "SYP", "YER", "TND", "MAD", "DZD", "SDG", "LYD",
    "جنيه", "دولار", "يورو", "ريال", "درهم", "دينار",
]

# --- fixed values: message states and card patterns --------------------------------------

STATES = ["MONETARY", "PROMO", "OTP", "DECLINED", "UNKNOWN"]
OTP_PATTERN = r"\b(otp|one\s*time\s*password|code)\b"
DECLINED_PATTERN = r"\b(declined|refused)\b"
CARD_SUFFIX_PATTERNS = [
    r"(?:ending|card ending|ends with)\s+(\d{4})(?!\d)",
    r"(?:card|Card)\s+(?:number\s+)?(?:\*+\s*)?(\d{4})(?!\d)",
    r"\*+(\d{4})(?!\d)",
    r"(?:رقم|بطاقة رقم|ينتهي)\s+(\d{4})(?!\d)",
    r"(?:بطاقة)\s+(?:\*+\s*)?(\d{4})(?!\d)",
]

# --- fixed values: promotional keywords --------------------------------------------------

PROMO_LATIN = [
    "offer", "discount", "sale", "enjoy", "special offer", "limited time", "promotion", "promo", "deal", "deals",
    "save", "saving", "cashback", "reward", "rewards", "exclusive", "free", "gift", "bonus", "win", "winner",
    "congratulations", "congrats", "voucher", "coupon", "redeem", "off", "% off", "percent off",
]
PROMO_ARABIC = [
    "عرض خاص", "لفترة محدودة", "عروض", "توفير", "مجاني", "هدية", "مكافأة", "مكافآت", "حصري", "خصومات", "استمتع",
    "تخفيض", "تخفيضات", "كاش باك", "قسيمة", "كوبون", "مبروك", "فائز", "اربح", "جائزة", "وفر الآن", "احصل على", "فرصة",
]

# --- fixed values: bank patterns, first bank that matches wins ----------------------------

BANK_PATTERNS = {
    "HSBC": ["HSBC", "Your HSBC card", "HSBC Egypt", r"hsbc\.com", "HSBC Bank"],
    "CIB": ["CIB", "بطاقتك من CIB", "Commercial International Bank", "CIB Egypt", "CIB Card", "CIB-"],
    "NBE": ["NBE", "National Bank of Egypt", "البنك الأهلي", "NBE Card", "الاهلى المصرى"],
    "Banque_Misr": ["Banque Misr", "بنك مصر", "BM-", "Banque-Misr"],
    "QNB": ["QNB", "بنك قطر الوطنى", "QNB ALAHLI", "QNB Egypt", "QNBALAHLI"],
    "Alex_Bank": ["Alex Bank", "بنك الإسكندرية", "AlexBank", "Bank of Alexandria"],
    "Banque_Du_Caire": ["Banque Du Caire", "بنك القاهرة", "BDC", "Banque-Du-Caire"],
    "AAIB": ["AAIB", "Arab African", "Arab African International Bank", "البنك العربي الافريقي"],
    "SAIB": ["SAIB", "Societe Arabe", "البنك العربي الدولي", "SAIB Bank"],
    "ADIB": ["ADIB", "Abu Dhabi Islamic", "ابو ظبى الاسلامى", "ADIB Egypt"],
    "Faisal_Islamic": ["Faisal Islamic", "بنك فيصل", "Faisal Bank"],
    "Emirates_NBD": ["Emirates NBD", "بنك الإمارات", "ENBD"],
    "BLOM": ["BLOM", "بلوم بنك", "BLOM Bank"],
    "Credit_Agricole": ["Credit Agricole", "كريدى اجريكول", "CA Egypt"],
    "Citibank": ["Citibank", "Citi", "سيتى بنك", "CitiBank Egypt"],
    "Barclays": ["Barclays", "باركليز"],
    "Standard_Chartered": ["Standard Chartered", "ستاندرد تشارترد", "SCB"],
    "Vodafone_Cash": ["Vodafone Cash", "فودافون كاش", "VF Cash"],
    "Etisalat_Cash": ["Etisalat Cash", "اتصالات كاش"],
    "Orange_Cash": ["Orange Cash", "اورنج كاش"],
    "Fawry": ["Fawry", "فورى", "FAWRY"],
    "Masary": ["Masary", "مصاري", "Masary Payment"],
    "Generic_Bank": ["بطاقة", "card ending", "account ending", "تم الخصم", "تم الإيداع", "balance is", "رصيدك"],
}

# --- fixed values: risk profiles ----------------------------------------------------------

RISK_PROFILES = {
    "conservative": {"reserve_months": 6, "equity_allocation": 0.45},
    "balanced": {"reserve_months": 4, "equity_allocation": 0.6},
    "aggressive": {"reserve_months": 3, "equity_allocation": 0.75},
}

# --- fixed values: ledger columns ---------------------------------------------------------

LEDGER_COLUMNS = [
    "id", "date", "payee", "category", "subcategory", "amount", "account_id", "account_type", "interest_rate",
    "tags", "urgency", "currency", "anomalies", "confidence", "message_hash",
]
REPORT_COLUMNS = [
    "id", "date", "payee", "normalized_merchant", "category", "subcategory", "amount", "currency", "account_id",
    "account_type", "interest_rate", "tags", "urgency", "confidence", "anomalies",
]
