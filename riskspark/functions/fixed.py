"""Fixed values.

Everything here is a value other tools agree on: word lists, patterns, weights,
thresholds and output formats.  Results are only right when these are exact, so
they are stated plainly, in natural order, and nowhere else.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: lexical patterns
# ---------------------------------------------------------------------------
SHELL_INTERPRETERS = ["sh", "bash", "dash", "zsh", "ksh", "csh", "tcsh"]

URL_PATTERN = r"""\b(?:https?|ftp|ftps)://[^\s'"|;&)]+"""
PATH_BODY = r"(/[A-Za-z0-9_.\-/]+|~/[A-Za-z0-9_.\-/]*)"
DEVICE_PATTERN = r"/dev/[A-Za-z0-9/]+"
SUBSTITUTION_PATTERN = r"\$\(|`"
HEREDOC_PATTERN = r"""<<-?\s*["']?[A-Za-z_]"""
SEGMENT_PATTERN = r"\|\||&&|[;|&\n]"
ASSIGNMENT_PATTERN = r"^[A-Za-z_][A-Za-z0-9_]*="
SKIPPED_WORDS = ["do", "then", "else", "fi", "done", "{", "}", "(", ")"]

# ---------------------------------------------------------------------------
# FIXED VALUES: execution-context evidence
# ---------------------------------------------------------------------------
PRIVILEGED_COMMANDS = ["sudo", "su", "doas", "pkexec", "setcap", "visudo"]
NETWORK_COMMANDS = ["curl", "wget", "nc", "ncat", "netcat", "ssh", "scp", "ftp",
                    "telnet", "socat", "rsync", "tftp"]
DESTRUCTIVE_COMMANDS = ["rm", "dd", "mkfs", "shred", "fdisk", "parted", "wipefs", "mke2fs"]
SENSITIVE_ROOTS = ["/etc", "/boot", "/usr", "/bin", "/sbin", "/lib", "/dev",
                   "/var", "/root", "/sys", "/proc"]

PRIVILEGE_PATTERN = r"NOPASSWD|/etc/sudoers|chmod\s+(\+s|4[0-7]{3})"
DEV_NET_PATTERN = r"/dev/(tcp|udp)/"
RECURSIVE_FLAG_PATTERN = r"-[a-zA-Z]*[rR][a-zA-Z]*\b"
BROAD_TARGET_PATTERN = r"\s(/|/\*|~|\$HOME)(\s|$)"
RM_FLAG_PATTERN = r"\brm\b[^\n]*-[a-zA-Z]*[rf]"
DEVICE_WRITE_PATTERN = r"\bdd\b[^\n]*of=/dev/|mkfs|--no-preserve-root|>\s*/dev/sd"
SHRED_PATTERN = r"\b(shred|wipefs)\b"
BASE64_PATTERN = r"\bbase64\s+(-d|--decode)\b"
EVAL_PATTERN = r"\beval\b"
HEX_RUN_PATTERN = r"(\\x[0-9a-fA-F]{2}){4,}"
PRINTF_OCTAL_PATTERN = r"\$\(\s*printf[^\n]*\\[0-7]{3}"
REVERSE_PATTERN = r"\brev\b|\btr\b[^\n]*\["
SUBSTITUTIONS_PER_LINE = 1.5

# ---------------------------------------------------------------------------
# FIXED VALUES: signature knowledge base (id, category, weight, pattern, reason)
# ---------------------------------------------------------------------------
SIGNATURE_CATEGORIES = {
    "destructive": "data, filesystem or device loss that cannot be undone",
    "privilege": "gaining or needing elevated rights",
    "network_egress": "outbound traffic, fetching or running remote code",
    "obfuscation": "encodings and indirection that hide intent",
    "persistence": "surviving a reboot or a new session",
    "exfiltration": "moving data off the host",
    "tampering": "changing sensitive system configuration",
    "benign_signal": "signs of careful authoring (negative weight)",
}

SIGNATURES = [
    ("rm_rf_root", "destructive", 9.5,
     r"\brm\s+(-[a-zA-Z]*\s+)*-[a-zA-Z]*[rf][a-zA-Z]*\s+(--no-preserve-root\s+)?(/|/\*|~|\$HOME)(\s|$)",
     "recursive removal of the root or home tree"),
    ("rm_rf_generic", "destructive", 4.0,
     r"\brm\s+(-[a-zA-Z]*\s+)*-[a-zA-Z]*[rf][a-zA-Z]*[rf][a-zA-Z]*\b",
     "recursive forced removal"),
    ("no_preserve_root", "destructive", 5.0, r"--no-preserve-root",
     "root guard of rm switched off"),
    ("dd_to_device", "destructive", 7.5,
     r"\bdd\b[^\n]*\bof=/dev/(sd|nvme|hd|mmcblk|disk|vd)[a-z0-9]*",
     "raw write to a block device"),
    ("mkfs_format", "destructive", 7.0, r"\bmkfs(\.[a-z0-9]+)?\b[^\n]*\b/dev/",
     "formats a device"),
    ("fork_bomb", "destructive", 8.5, r":\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:",
     "self-replicating function"),
    ("fork_bomb_loose", "destructive", 6.0,
     r"\}\s*;\s*:\s*$|\b(while\s+true|for\s*\(\(;;\)\))\b[^\n]*&\s*$",
     "endless loop that starts background jobs"),
    ("overwrite_block_device", "destructive", 6.5, r">\s*/dev/(sd|nvme|hd|mmcblk)[a-z0-9]*",
     "redirect onto a block device"),
    ("chmod_777", "tampering", 3.0, r"\bchmod\s+(-[a-zA-Z]*\s+)*0?777\b",
     "world-writable mode"),
    ("chmod_recursive_root", "tampering", 4.5,
     r"\bchmod\s+-R[^\n]*\s(/|/etc|/usr|/bin|/var)(\s|$)",
     "recursive mode change on a system tree"),
    ("curl_pipe_shell", "network_egress", 7.0,
     r"\b(curl|wget|fetch)\b[^\n|]*\|\s*(sudo\s+)?(ba)?sh\b",
     "download piped into a shell"),
    ("remote_exec_eval", "network_egress", 6.0, r"""\beval\s+"?\$\(\s*(curl|wget)\b""",
     "eval of a download"),
    ("wget_o_exec", "network_egress", 5.0, r"\bwget\b[^\n]*-O\s*-\s*[^\n]*\|\s*(ba)?sh",
     "streamed download into a shell"),
    ("reverse_shell_bash", "network_egress", 9.0, r"(ba)?sh\s+-i\s*>&?\s*/dev/tcp/",
     "interactive shell on a TCP pseudo-device"),
    ("reverse_shell_nc", "network_egress", 8.5, r"\bnc(at)?\b[^\n]*(-e|\s-c)\s*(/bin/)?(ba)?sh",
     "netcat that starts a shell"),
    ("reverse_shell_python", "network_egress", 8.5,
     r"python[0-9]?\s+-c[^\n]*socket[^\n]*(connect|pty\.spawn)",
     "interpreter one-liner that opens a socket"),
    ("dev_tcp_redirect", "network_egress", 6.5, r"/dev/(tcp|udp)/[0-9a-zA-Z.\-]+/[0-9]+",
     "network pseudo-device"),
    ("base64_decode_exec", "obfuscation", 6.5,
     r"\bbase64\s+(-d|--decode)\b[^\n]*\|\s*(ba)?sh",
     "decoded text piped into a shell"),
    ("base64_decode_present", "obfuscation", 2.5, r"\bbase64\s+(-d|--decode)\b",
     "base64 decoding"),
    ("eval_present", "obfuscation", 2.0, r"\beval\b", "dynamic evaluation"),
    ("hex_decode_exec", "obfuscation", 4.0,
     r"\b(xxd\s+-r|printf)\b[^\n]*(\\x[0-9a-fA-F]{2}){4,}",
     "hex-encoded text"),
    ("char_obfuscation", "obfuscation", 3.0, r"\$\(\s*printf[^\n]*\\[0-7]{3}",
     "octal characters built with printf"),
    ("string_reverse_exec", "obfuscation", 3.5,
     r"\brev\b[^\n]*\|\s*(ba)?sh|\$\(\s*echo[^\n]*\|\s*rev\s*\)",
     "reversed text run as a command"),
    ("sudo_present", "privilege", 2.5, r"\bsudo\b", "elevated rights"),
    ("sudo_nopasswd", "privilege", 5.0, r"NOPASSWD|echo[^\n]*>>\s*/etc/sudoers",
     "password-free elevation"),
    ("setuid_bit", "privilege", 5.0,
     r"\bchmod\s+(-[a-zA-Z]*\s+)*([u]?\+s|4[0-7]{3})\b", "setuid mode"),
    ("crontab_edit", "persistence", 4.0,
     r"\bcrontab\b[^\n]*(-|<)|>>?\s*/etc/cron|/etc/cron\.[a-z]+/", "scheduled job changed"),
    ("systemd_persistence", "persistence", 4.0,
     r">\s*/etc/systemd/system/|\bsystemctl\s+enable\b", "service installed or enabled"),
    ("rc_local_persistence", "persistence", 3.5,
     r">>?\s*(/etc/rc\.local|~?/\.bashrc|~?/\.bash_profile|~?/\.profile)",
     "startup file written"),
    ("ssh_authorized_keys", "persistence", 5.5, r">>?\s*[^\n]*\.ssh/authorized_keys",
     "login key added"),
    ("etc_write", "tampering", 3.5, r">>?\s*/etc/(passwd|shadow|hosts|fstab|crontab|ld\.so)",
     "sensitive configuration file written"),
    ("iptables_flush", "tampering", 3.0, r"\biptables\b[^\n]*(-F|--flush)|\bufw\s+disable\b",
     "firewall rules dropped"),
    ("history_clear", "tampering", 3.0,
     r"\b(history\s+-c|>\s*~?/\.bash_history|unset\s+HISTFILE)\b", "shell history cleared"),
    ("data_exfil_curl", "exfiltration", 4.5,
     r"\b(curl|wget)\b[^\n]*(--data|-d|-F|--upload-file|-T)\b[^\n]*(http|ftp)",
     "local data uploaded"),
    ("etc_passwd_read_send", "exfiltration", 5.0,
     r"/etc/(passwd|shadow)[^\n]*\|\s*(curl|wget|nc)", "credential file sent away"),
    ("wipe_logs", "tampering", 3.5, r">\s*/var/log/|\brm\b[^\n]*/var/log/", "logs destroyed"),
    ("kill_security_tools", "tampering", 4.0,
     r"\b(systemctl\s+stop|service)\b[^\n]*(auditd|firewalld|apparmor|selinux)",
     "security service stopped"),
    ("shebang_present", "benign_signal", -0.5,
     r"^#!\s*/usr/bin/env\s+bash|^#!\s*/bin/(ba)?sh", "interpreter line"),
    ("set_euo_pipefail", "benign_signal", -1.0,
     r"set\s+-[a-z]*e[a-z]*\b|set\s+-o\s+pipefail", "strict mode"),
    ("comment_density_marker", "benign_signal", -0.5, r"(^|\n)\s*#\s*[A-Za-z]{3,}",
     "explanatory comment"),
]

# Substrings a text must contain before a pattern can match: every group must be
# present, any member of a group is enough.  Read off the patterns above; they
# only save regex runs.
SIGNATURE_NEEDS = {
    "rm_rf_root": [["rm"], ["-"]],
    "rm_rf_generic": [["rm"], ["-"]],
    "no_preserve_root": [["--no-preserve-root"]],
    "dd_to_device": [["of=/dev/"]],
    "mkfs_format": [["mkfs"], ["/dev/"]],
    "fork_bomb": [[":()"]],
    "fork_bomb_loose": [["}", "true", "((;;))"]],
    "overwrite_block_device": [["/dev/"], [">"]],
    "chmod_777": [["777"]],
    "chmod_recursive_root": [["chmod"]],
    "curl_pipe_shell": [["|"], ["curl", "wget", "fetch"]],
    "remote_exec_eval": [["eval"], ["curl", "wget"]],
    "wget_o_exec": [["wget"], ["|"]],
    "reverse_shell_bash": [["/dev/tcp/"]],
    "reverse_shell_nc": [["nc"], ["sh"], ["-"]],
    "reverse_shell_python": [["python"], ["socket"]],
    "dev_tcp_redirect": [["/dev/tcp/", "/dev/udp/"]],
    "base64_decode_exec": [["base64"], ["|"]],
    "base64_decode_present": [["base64"]],
    "eval_present": [["eval"]],
    "hex_decode_exec": [["\\x"], ["xxd", "printf"]],
    "char_obfuscation": [["$("], ["printf"]],
    "string_reverse_exec": [["rev"]],
    "sudo_present": [["sudo"]],
    "sudo_nopasswd": [["NOPASSWD", "/etc/sudoers"]],
    "setuid_bit": [["chmod"]],
    "crontab_edit": [["cron"]],
    "systemd_persistence": [["/etc/systemd/system/", "systemctl"]],
    "rc_local_persistence": [[">"], ["/etc/rc.local", "/.bashrc", "/.bash_profile", "/.profile"]],
    "ssh_authorized_keys": [[".ssh/authorized_keys"]],
    "etc_write": [["/etc/"], [">"]],
    "iptables_flush": [["iptables", "ufw"]],
    "history_clear": [["history", "HISTFILE"]],
    "data_exfil_curl": [["curl", "wget"], ["http", "ftp"], ["-"]],
    "etc_passwd_read_send": [["/etc/passwd", "/etc/shadow"], ["|"]],
    "wipe_logs": [["/var/log/"]],
    "kill_security_tools": [["auditd", "firewalld", "apparmor", "selinux"]],
    "shebang_present": [["#!"]],
    "set_euo_pipefail": [["set"], ["-"]],
    "comment_density_marker": [["#"]],
}
CONTEXT_NEEDS = {
    PRIVILEGE_PATTERN: ["NOPASSWD", "/etc/sudoers", "chmod"],
    DEV_NET_PATTERN: ["/dev/"],
    RECURSIVE_FLAG_PATTERN: ["-"],
    BROAD_TARGET_PATTERN: ["/", "~", "$HOME"],
    RM_FLAG_PATTERN: ["rm"],
    DEVICE_WRITE_PATTERN: ["of=/dev/", "mkfs", "--no-preserve-root", "/dev/sd"],
    SHRED_PATTERN: ["shred", "wipefs"],
    BASE64_PATTERN: ["base64"],
    EVAL_PATTERN: ["eval"],
    HEX_RUN_PATTERN: ["\\x"],
    PRINTF_OCTAL_PATTERN: ["printf"],
    REVERSE_PATTERN: ["rev", "tr"],
}

# ---------------------------------------------------------------------------
# FIXED VALUES: risk model
# ---------------------------------------------------------------------------
SCORING_DESTRUCTIVE = ["rm", "dd", "mkfs", "shred", "fdisk", "wipefs", "parted"]
SCORING_NETWORK = ["curl", "wget", "nc", "ncat", "netcat", "ssh", "scp", "socat", "ftp", "telnet"]

FEATURE_GROUPS = {
    "semantic": ["semantic_pipes_to_shell", "semantic_has_destructive_cmd",
                 "semantic_has_network_cmd", "semantic_has_device_target",
                 "semantic_cmd_substitution_density"],
    "context": ["context_privilege_required", "context_network_egress",
                "context_filesystem_scope", "context_irreversibility", "context_obfuscation"],
    "threat": ["threat_weight_norm", "threat_max_category_norm", "threat_distinct_categories"],
}
FEATURES = [f for group in FEATURE_GROUPS.values() for f in group]

DEFAULT_WEIGHTS = {
    "semantic_pipes_to_shell": 1.6,
    "semantic_has_destructive_cmd": 1.1,
    "semantic_has_network_cmd": 0.7,
    "semantic_has_device_target": 1.3,
    "semantic_cmd_substitution_density": 0.6,
    "context_privilege_required": 1.2,
    "context_network_egress": 1.3,
    "context_filesystem_scope": 1.4,
    "context_irreversibility": 1.8,
    "context_obfuscation": 1.7,
    "threat_weight_norm": 3.4,
    "threat_max_category_norm": 1.5,
    "threat_distinct_categories": 0.9,
}
DEFAULT_BIAS = -2.4
DEFAULT_THRESHOLD = 0.5
SIGNATURE_WEIGHT_SCALE = 10.0
CATEGORY_WEIGHT_SCALE = 9.5
CATEGORY_COUNT_SCALE = 5.0
LEVEL_BOUNDS = [(0.25, "TRUSTED"), (0.50, "MONITOR"), (0.80, "RESTRICT")]
TOP_LEVEL = "DENY"
LEVELS = ["TRUSTED", "MONITOR", "RESTRICT", "DENY"]

# ---------------------------------------------------------------------------
# FIXED VALUES: execution policy per trust level
# ---------------------------------------------------------------------------
BASE_SYSCALLS = ["read", "write", "close", "fstat", "lseek", "mmap", "munmap", "brk",
                 "rt_sigaction", "rt_sigprocmask", "exit", "exit_group", "arch_prctl",
                 "access", "openat", "newfstatat", "getrandom"]
LEVEL_SYSCALLS = {
    "TRUSTED": ["stat", "getdents64", "fcntl", "clone", "execve", "wait4", "pipe2", "dup2",
                "socket", "connect", "fork", "vfork", "setuid", "setgid"],
    "MONITOR": ["stat", "getdents64", "fcntl", "clone", "execve", "wait4", "pipe2", "dup2"],
    "RESTRICT": ["stat", "getdents64", "fcntl"],
    "DENY": [],
}
# level: decision, network, new_privileges, read_only_rootfs, cpu_quota, memory_limit, pids_limit
LEVEL_POSTURE = {
    "TRUSTED": ("allow", "allow", True, False, "unlimited", "unlimited", 4096),
    "MONITOR": ("allow_with_audit", "allow", False, False, "50%", "1g", 512),
    "RESTRICT": ("sandbox", "deny", False, True, "20%", "256m", 64),
    "DENY": ("deny", "deny", False, True, "0%", "0", 0),
}
NETWORK_DENIED_SYSCALLS = ["socket", "connect", "bind", "sendto", "recvfrom"]
KILLED_SYSCALLS = ["execve", "execveat", "fork", "vfork", "clone"]
ARCHITECTURES = ["SCMP_ARCH_X86_64", "SCMP_ARCH_AARCH64"]
ACT_ALLOW, ACT_ERRNO, ACT_KILL = "SCMP_ACT_ALLOW", "SCMP_ACT_ERRNO", "SCMP_ACT_KILL_PROCESS"
NAMESPACES = ["pid", "mount", "uts", "ipc"]
DROPPED_CAPABILITIES = ["NET_ADMIN", "SYS_ADMIN", "SYS_MODULE"]
# names, action, comment
NETWORK_RULE = (NETWORK_DENIED_SYSCALLS, ACT_ERRNO, "network egress blocked at this trust level")
KILL_RULE = (KILLED_SYSCALLS, ACT_KILL, "execution denied")
# level: default action, rules after the allowed syscalls, namespaces, dropped capabilities
LEVEL_SANDBOX = {
    "TRUSTED": (ACT_ALLOW, [], NAMESPACES, DROPPED_CAPABILITIES),
    "MONITOR": (ACT_ERRNO, [], NAMESPACES, DROPPED_CAPABILITIES),
    "RESTRICT": (ACT_ERRNO, [NETWORK_RULE], [*NAMESPACES, "net"], ["ALL"]),
    "DENY": (ACT_ERRNO, [NETWORK_RULE, KILL_RULE], [*NAMESPACES, "net"], ["ALL"]),
}
PROFILE_COMMENT = "seccomp profile for trust level "
ALLOWING_DECISIONS = ["allow", "allow_with_audit"]
AUDITING_DECISIONS = ["allow_with_audit", "sandbox"]
REASONS = {
    "kill": "syscall on kill list at this trust level",
    "block": "syscall explicitly blocked by policy",
    "audit": "allowed (audited)",
    "allow": "allowed by policy",
    "default_block": "blocked by default action (not allow-listed)",
    "default_allow": "permitted by default-allow policy",
}

# Content-derived deny set.
SPAWN_COMMANDS = ["bash", "sh", "python", "python3", "perl", "ruby", "php", "node", "make",
                  "gcc", "sudo", "su", "env", "xargs", "at", "crontab", "systemctl"]
DENY_WITHOUT_NETWORK = ["socket", "connect", "sendto", "recvfrom"]
DENY_WITHOUT_SPAWN = ["execve", "execveat"]
DENY_ALWAYS = ["ptrace"]

# ---------------------------------------------------------------------------
# FIXED VALUES: text rewrites of the evasion study
# ---------------------------------------------------------------------------
BENIGN_HEADER = (
    "#!/usr/bin/env bash\n"
    "set -euo pipefail\n"
    "# Routine maintenance task, reviewed and approved by the ops team.\n"
    "# This script is idempotent and safe to re-run.\n"
    "# See runbook RB-142 for context and rollback steps.\n"
)
HOST_DISGUISE = [
    (r"malware\.test", "cdn.internal-tools.example"),
    (r"evil-host\.test", "mirror.company-cache.example"),
    (r"attacker\.example\.com", "assets.company-cdn.example"),
    (r"bad-actor\.example\.org", "pkg.company-repo.example"),
    (r"c2\.example\.net", "telemetry.company-ops.example"),
    (r"185\.243\.5\.7", "10.20.30.40"),
    (r"203\.0\.113\.9", "10.20.30.41"),
    (r"198\.51\.100\.7", "10.20.30.42"),
    (r"\bpayload\b", "artifact"),
]
# (name, pattern, replacement); \1 marks a group in the replacement.
SUBSTITUTIONS = [
    ("rm_to_find", r"\brm\s+-[a-zA-Z]*r[a-zA-Z]*f?[a-zA-Z]*\s+(\S+)",
     r"find \1 -mindepth 0 -delete"),
    ("nc_to_socat", r"\bnc(?:at)?\s+-e\s+(/bin/(?:ba)?sh)\s+(\S+)\s+(\S+)",
     r"socat TCP:\2:\3 EXEC:\1"),
    ("devtcp_to_socat", r"(?:ba)?sh\s+-i\s*>&?\s*/dev/tcp/([0-9a-zA-Z.\-]+)/([0-9]+)\s*0>&1",
     r"socat TCP:\1:\2 EXEC:'/bin/bash -li',pty,stderr"),
    ("curlpipe_to_staged", r"\b(curl|wget)\b([^\n|]*?)\|\s*(sudo\s+)?(?:ba)?sh\b",
     r"\1\2-o /tmp/.stage; chmod +x /tmp/.stage; \3/tmp/.stage"),
    ("curl_to_python", r"\bcurl\s+-fsSL\s+(\S+)",
     r"python3 -c \"import urllib.request,os;os.system(urllib.request.urlopen('\1').read().decode())\""),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: evaluation
# ---------------------------------------------------------------------------
SPLIT_SEED = 1337
ABLATIONS = [("full", []), ("no_semantic", ["semantic"]), ("no_context", ["context"]),
             ("no_threat", ["threat"])]
KAPPA_BANDS = [(0.0, "worse than chance"), (0.20, "slight"), (0.40, "fair"),
               (0.60, "moderate"), (0.80, "substantial")]
KAPPA_TOP_BAND = "almost perfect"
FENCE_PATTERN = r"```(?:bash|sh|shell|zsh)?\s*\n(.*?)```"
WORD_TOKEN_PATTERN = r"(?U)\b\w\w+\b"
REGULARISATION_GRID = [0.25, 1.0, 4.0, 16.0]
