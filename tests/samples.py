"""Sample logs of our own, one scenario per format, with known counts."""

import json

ATTACKER, SECOND, STAFF = "192.0.2.10", "192.0.2.77", "198.51.100.20"


def auth():
    out, at = [], 0

    def say(process, message):
        nonlocal at
        at += 1
        out.append(f"Feb  3 04:{at // 60:02d}:{at % 60:02d} gate1 {process}: {message}")

    for name in ("ada", "bob", "cyd", "dan", "eve", "fay"):
        say("sshd[10]", f"Invalid user {name} from {ATTACKER} port 4000")
        say("sshd[10]", f"Failed password for invalid user {name} from {ATTACKER} port 4000 ssh2")
    for _ in range(3):
        say("sshd[11]", f"Failed password for root from {ATTACKER} port 4001 ssh2")
    say("sshd[11]", f"Accepted password for root from {ATTACKER} port 4002 ssh2")
    say("sudo", "root : TTY=pts/1 ; COMMAND=/bin/sh")
    for _ in range(2):
        say("sshd[12]", f"Failed password for invalid user bob from {SECOND} port 4100 ssh2")
    say("sshd[13]", f"Accepted publickey for ops from {STAFF} port 22 ssh2")
    say("sshd[13]", "pam_unix(sshd:session): session opened for user ops by (uid=0)")
    return out


def web():
    out = []

    def hit(ip, target, status, agent):
        out.append(f'{ip} - - [03/Feb/2024:04:00:{len(out):02d} +0000] "GET {target} HTTP/1.1" {status} 9 "-" "{agent}"')

    for n in range(20):
        hit(ATTACKER, f"/probe{n}", 404 if n else 403, "sqlmap/9")
    hit(ATTACKER, "/p?id=1%27%20OR%20%271%27=%271", 500, "Mozilla/5.0")
    hit(ATTACKER, "/p?id=1%20UNION%20SELECT%20x", 500, "Mozilla/5.0")
    hit(SECOND, "/../../etc/hosts", 403, "Nikto/3")
    hit(SECOND, "/s?q=%3Cscript%3E1%3C/script%3E", 404, "Mozilla/5.0")
    hit(SECOND, "/shell.php?x=1", 404, "curl/8")
    hit(SECOND, "/c99.php", 404, "curl/8")
    hit(STAFF, "/home", 200, "Mozilla/5.0 (X11)")
    return out


def windows():
    def line(n, event_id, category, message):
        return f"02/03/2024 04:00:{n:02d} AM Microsoft-Windows-Sample {event_id} {category}\t{message}"

    ids = [4625] * 6 + [4672, 4720, 4732, 4698, 7045] + [4769] * 4 + [1102]
    return [line(n, i, "Logon Kind", f"what {i} did") for n, i in enumerate(ids)]


def firewall():
    rows = ["timestamp,src_ip,dst_ip,dst_port,protocol,action,username"]
    rows += [f"2024-02-03T04:00:{n:02d}Z,{ATTACKER},10.0.0.5,{20 + n},tcp,deny,-" for n in range(13)]
    rows += [f"2024-02-03T04:01:{n:02d}Z,{SECOND},10.0.0.8,22,tcp,deny,-" for n in range(2)]
    return rows + [f"2024-02-03T04:02:00Z,{STAFF},10.0.0.9,443,tcp,allow,ops"]


def cloud():
    def record(name, user, **more):
        return {"eventTime": "2024-02-03T04:00:00Z", "eventName": name, "sourceIPAddress": ATTACKER,
                "userIdentity": {"type": "IAMUser", "userName": user}, **more}

    failed = {"errorMessage": "Failed authentication", "responseElements": {"ConsoleLogin": "Failure"}}
    out = [record("ConsoleLogin", f"u{n}", **failed) for n in range(5)]
    out.append(record("ConsoleLogin", "u0", responseElements={"ConsoleLogin": "Success"}))
    out.append(record("CreateUser", "root", requestParameters={"userName": "hidden"}))
    out += [record(n, "root") for n in ("AttachUserPolicy", "CreateAccessKey", "StopLogging")]
    return json.dumps({"Records": out}, indent=1)


def event(event_id, **data):
    items = "".join(f'<Data Name="{k}">{v}</Data>' for k, v in data.items())
    return (f'<Event xmlns="urn:x"><System><Provider Name="P"/><EventID>{event_id}</EventID>'
            f"<Computer>WS1</Computer></System><EventData>{items}</EventData></Event>")


def winevents():
    ids = [4625] * 5 + [4769] * 3 + [1102, 4732, 4720]
    return "<Events>\n" + "\n".join(event(i, TargetUserName="x", IpAddress=ATTACKER) for i in ids) + "\n</Events>\n"
