"""Words that mark confidential data, and the logging calls they are looked for in.

One secret rule exists for every word and every call of a language, in this order; see ``rules.py``.
"""

WORDS = """
access_token auth_cooki auth_token bearer_token client_key client_secret consumer_key csrf csrf_token
id_token jwt_secret login_token refresh_token security_token session_id session_token token xsrf xsrf_token
api-key api_key apikey appkey aws_access_key aws_secret_key aws_session_token azure_client_id
azure_client_secret azure_key azure_tenant_id gcp_api_key
cred credenti database_password db_password db_user ftp_password login_id loginpass loginpwd pass passwd
password pwd redis_password smtp_password user user_id userid usernam userpass userpwd
aes_key decryption_key encryption_key gpg_key key_materi pem_key private_key private_secret public_key
rsa_key secret secret_key secrettoken shared_secret signing_key ssh_key
account_numb bank_account bic card_numb cc_number ccv credit_card cvc cvv exp_dat expiry_d iban pin
routing_numb social_security_numb ssn swift_cod tax_id vat_id
address birthdat countri dob email first_nam full_nam last_nam locat mobil name phone postal_cod zipcod
connection_str jdbc_url mongo_uri sql_connection_str
cooki cookie_valu
""".split()

CALLS = {
    "python": [r"logger\.\w+\s*\(", r"print\s*\(", r"log\s*\(", r"logging\.\w+\s*\("],
    "java": [r"logger\.\w+\s*\(", r"log\.\w+\s*\(", r"System\.out\.print\w*\s*\("],
    "javascript": [r"console\.\w+\s*\(", r"logger\.\w+\s*\(", r"log\s*\("],
    "typescript": [r"console\.\w+\s*\(", r"logger\.\w+\s*\(", r"log\s*\("],
    "csharp": [r"_logger\.Log\w+\s*\(", r"Console\.Write\w*\s*\(", r"Debug\.Write\w*\s*\("],
    "dotnet": [],
}

# The written form of a rule: call, then anything, then the word inside the call's brackets.
RULE_FORM = "{call}[^)]*(?i).*{word}([_\\-]?[a-z0-9]*)?.*[^)]*\\)"

# Rules without a call/word split, used for every language.
BASIC = [
    r"""log.*["\'].*password.*["\']""",
    r"""log.*["\'].*token.*["\']""",
    r"""log.*["\'].*secret.*["\']""",
    r"""log.*["\'].*key.*["\']""",
    r"""log.*["\'].*api_key.*["\']""",
    r"""log.*["\'].*auth.*["\']""",
    r"print.*password",
    r"print.*token",
    r"console\.log.*password",
    r"console\.log.*token",
]
