"""Part of sparkloom: operators."""
