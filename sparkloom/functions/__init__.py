"""Part of sparkloom: functions."""
