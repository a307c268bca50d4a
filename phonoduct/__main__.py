import sys

from phonoduct.plans.commands import main

main(sys.argv[1:])
