"""Settings and commands that every catalog of a platform holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions import paths, text
from trigrove.operators.catalog import as_catalog

# Settings panels of the unix desktop (fixed values): name | panel | category
UNIX_SETTINGS = """
Settings | com.system76.CosmicSettings | System
Accessibility | com.system76.CosmicSettings.Accessibility | System
Appearance | com.system76.CosmicSettings.Appearance | Desktop
Applications | com.system76.CosmicSettings.Applications | System
Background | com.system76.CosmicSettings.Wallpaper | Desktop
Bluetooth | com.system76.CosmicSettings.Bluetooth | Connections
Date & Time | com.system76.CosmicSettings.Time | System
Default Applications | com.system76.CosmicSettings.DefaultApps | System
Desktop | com.system76.CosmicSettings.Desktop | Desktop
Displays | com.system76.CosmicSettings.Displays | Hardware
Keyboard | com.system76.CosmicSettings.Keyboard | Input
Mouse & Touchpad | com.system76.CosmicSettings.Input | Input
Network | com.system76.CosmicSettings.Network | Connections
Notifications | com.system76.CosmicSettings.Notifications | System
Panel | com.system76.CosmicSettings.Panel | Desktop
Power | com.system76.CosmicSettings.Power | System
Region & Language | com.system76.CosmicSettings.RegionLanguage | System
Sound | com.system76.CosmicSettings.Sound | Hardware
Startup Applications | com.system76.CosmicSettings.StartupApps | System
Users | com.system76.CosmicSettings.Users | System
Window Management | com.system76.CosmicSettings.WindowManagement | Desktop
Workspaces | com.system76.CosmicSettings.Workspaces | Desktop
"""

# Settings of the windows desktop (fixed values): name | target | category | tags
WINDOWS_SETTINGS = """
Settings | ms-settings: | System | preferences, control panel, general settings
System | ms-settings:about | System | about, device specifications, computer information
Display | ms-settings:display | System | monitor, screen, resolution, brightness
Sound | ms-settings:sound | System | audio, speakers, microphone, volume
Notifications | ms-settings:notifications | System | alerts, do not disturb
Power & Battery | ms-settings:powersleep | System | sleep, battery saver, energy
Storage | ms-settings:storagesense | System | disk, storage sense, cleanup
Clipboard | ms-settings:clipboard | System | copy, paste, history
Nearby Sharing | ms-settings:crossdevice | System | share, devices
Multitasking | ms-settings:multitasking | System | snap windows, desktops
Bluetooth & Devices | ms-settings:bluetooth | Connections | bluetooth, paired devices
Printers & Scanners | ms-settings:printers | Connections | printer, scanner
Mouse | ms-settings:mousetouchpad | Input | mouse settings, pointer, scroll
Touchpad | ms-settings:devices-touchpad | Input | trackpad, gestures
Typing | ms-settings:typing | Input | keyboard, spelling, text suggestions
Network & Internet | ms-settings:network-status | Connections | network, internet, wifi, ethernet
Wi-Fi | ms-settings:network-wifi | Connections | wireless, network
Ethernet | ms-settings:network-ethernet | Connections | wired network, lan
VPN | ms-settings:network-vpn | Connections | virtual private network
Airplane Mode | ms-settings:network-airplanemode | Connections | flight mode, wireless
Mobile Hotspot | ms-settings:network-mobilehotspot | Connections | tethering, share internet
Personalization | ms-settings:personalization | Desktop | appearance, theme, colors
Background | ms-settings:personalization-background | Desktop | wallpaper, desktop background
Colors | ms-settings:colors | Desktop | accent color, dark mode, light mode
Themes | ms-settings:themes | Desktop | theme, appearance
Lock Screen | ms-settings:lockscreen | Desktop | screen saver, login background
Taskbar | ms-settings:taskbar | Desktop | system tray, taskbar settings
Apps | ms-settings:appsfeatures | Applications | installed apps, programs, uninstall
Default Apps | ms-settings:defaultapps | Applications | file associations, browser
Startup Apps | ms-settings:startupapps | Applications | login apps, autostart
Optional Features | ms-settings:optionalfeatures | Applications | windows features
Accounts | ms-settings:yourinfo | Accounts | user, profile, microsoft account
Sign-in Options | ms-settings:signinoptions | Accounts | password, pin, windows hello
Family | ms-settings:family-group | Accounts | family safety, child account
Other Users | ms-settings:otherusers | Accounts | add user, local account
Windows Backup | ms-settings:backup | Accounts | sync, backup
Date & Time | ms-settings:dateandtime | System | clock, time zone, automatic time
Language & Region | ms-settings:regionlanguage | System | locale, keyboard language, country
Gaming | ms-settings:gaming-gamebar | Gaming | game bar, game mode, captures
Accessibility | ms-settings:easeofaccess | Accessibility | ease of access, assistive technology
Text Size | ms-settings:easeofaccess-display | Accessibility | font size, scaling
Magnifier | ms-settings:easeofaccess-magnifier | Accessibility | zoom, low vision
Narrator | ms-settings:easeofaccess-narrator | Accessibility | screen reader
Privacy & Security | ms-settings:privacy | Privacy | permissions, security
Windows Security | windowsdefender: | Privacy | defender, antivirus, firewall
Location Privacy | ms-settings:privacy-location | Privacy | gps, location permissions
Camera Privacy | ms-settings:privacy-webcam | Privacy | webcam, camera permissions
Microphone Privacy | ms-settings:privacy-microphone | Privacy | microphone permissions
Windows Update | ms-settings:windowsupdate | System | updates, update history, restart
Recovery | ms-settings:recovery | System | reset pc, advanced startup
For Developers | ms-settings:developers | System | developer mode, device portal
"""

# Commands of the windows desktop (fixed values): name | target | category | tags
WINDOWS_COMMANDS = """
File Explorer | explorer.exe | Windows Tools | files, folders, file manager, explorer
Windows Terminal | wt.exe | Windows Tools | terminal, console, shell, command line
PowerShell | powershell.exe | Windows Tools | terminal, shell, command line
Command Prompt | cmd.exe | Windows Tools | cmd, console, dos, terminal
Task Manager | taskmgr.exe | Windows Tools | process manager, performance, startup
Control Panel | control.exe | Windows Tools | classic settings, system settings
Run | explorer.exe shell:::{2559a1f3-21d7-11d4-bdaf-00c04f60b9f0} | Windows Tools | run dialog, execute
Calculator | calc.exe | Accessories | math, calculate
Notepad | notepad.exe | Accessories | text editor, notes
Paint | mspaint.exe | Accessories | drawing, image editor
Snipping Tool | snippingtool.exe | Accessories | screenshot, screen capture, snip
Character Map | charmap.exe | Accessories | symbols, unicode, special characters
Registry Editor | regedit.exe | Administration | registry, regedit
Services | services.msc | Administration | windows services, service manager
Event Viewer | eventvwr.msc | Administration | logs, windows logs, events
Device Manager | devmgmt.msc | Administration | hardware, drivers, devices
Disk Management | diskmgmt.msc | Administration | partitions, volumes, drives
Computer Management | compmgmt.msc | Administration | management console, admin tools
System Information | msinfo32.exe | Administration | hardware information, system details
Resource Monitor | resmon.exe | Administration | cpu, memory, disk, network monitor
"""


def _rows(spark: SparkSession, table: str, entry_type: str, icon: str | None, windows: bool) -> DataFrame:
    listed = []
    for position, line in enumerate(table.strip().splitlines()):
        name, target, category, *tags = [cell.strip() for cell in line.split("|")]
        listed.append((position, name, target, category, [t.strip() for t in tags[0].split(",")] if tags else []))
    base = spark.createDataFrame(
        listed, "position long, name string, path string, category string, tags array<string>"
    )
    tags = F.concat("tags", text.aliases(F.col("name"), windows))
    if windows:
        tags = text.distinct_tags(tags, F.col("name"), windows=True)
    metadata = F.struct(
        F.lit(None).cast("string").alias("file_type"),
        F.lit(None).cast("long").alias("file_size"),
        F.lit(False).alias("is_dir"),
        tags.alias("tags"),
        F.col("category"),
    )
    kind = F.lit(entry_type)
    return as_catalog(
        base.select(
            paths.stable_id(kind, F.col("path"), caseless=windows).alias("id"),
            kind.alias("entry_type"),
            "name",
            "path",
            F.lit(icon).cast("string").alias("icon_path"),
            metadata.alias("metadata"),
            "position",
        )
    )


def unix_settings(spark: SparkSession) -> DataFrame:
    return _rows(spark, UNIX_SETTINGS, "Setting", "preferences-system", False)


def windows_settings(spark: SparkSession) -> DataFrame:
    return _rows(spark, WINDOWS_SETTINGS, "Setting", None, True)


def windows_commands(spark: SparkSession) -> DataFrame:
    return _rows(spark, WINDOWS_COMMANDS, "Command", None, True)
