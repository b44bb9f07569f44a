"""Sentences written apart from the lexicon and its patterns, to be scored and not to be learned from."""

ABUSIVE = """You are an absolute buffoon and an imbecile to boot
I will smash your skull in if you show up tomorrow
Eres un idiota y siempre lo serás
What kind of mroon signs a contract like that without reading it
You utter morron, you broke the build again
Somebody should drown you in the lake behind the office
I hope your whole family dies in that house
Those people are nothing but cockroaches
Foreigners should be deported, every last one of them
Go back to your country, nobody wants your kind here
I can't stop thinking about you naked on the conference table
Send me a picture of your breasts tonight
I want to fuck you in the stairwell
You stupid bitch, answer the phone
you're such a pathetic looser
Shut your filthy mouth, you whoore
I'm going to break every finger on your hand and your jaw too
I know where you live and I know when you leave the house
You deserve to rot in prison and be beaten every day
Kill yourself, the world will not notice
Du bist ein Vollidiot, und das weißt du
Halt endlich deine Fresse, du Arschloch
Ferme ta gueule, espèce de connard
Tu es vraiment un abruti
Te voy a romper la cara, cabrón
Immigrants are vermin and they breed like rats
Women are too stupid to vote
All muslims are terrorists
He shoved his cock inside her while she moaned
Let me lick your thighs under the desk
i d i o t, you cannot even spell your own name
You are a w0rthless p1ece of garbage, you scumb@g
What a spineless coward you are
you brainless cretinn, do your job
I'll slit your throat in your sleep
May you choke on your lunch and die
You disgust me, crawl back under your rock
Only a halfwit like you would miss it
Your mother should be ashamed of having you
you f***ing idiot, look what you did""".splitlines()

HARMLESS = """The printer is an idiot of a machine today
I was such an idiot to forget the attachment, sorry
This stupid form keeps losing my entries
Please kill the process on the second node and restart it
The policy forbids calling colleagues idiots or worse
The clinic offers breast cancer screening in March
The court heard that the defendant had threatened the witness
We should put down the deposit before Friday
The damn server died again last night
The migrants' aid office is open until five
Put a bullet in front of each item of the list
The survey asks women about pay and promotion
My dog is sick and I have to take him to the vet
The rat population in the cellar needs pest control
They should be moved to the new building by May
You should see a doctor about that cough
I hope you feel better soon
Burn the image to a disk and ship it
Cut the tape along the edge of the face plate
The thief was caught by the security guard
He hit the target three times in the race
That was a killer presentation, congratulations
Sexual harassment training is mandatory for all staff
The naked wires must be covered before the inspection
Our team sucks at estimating, let us plan better
The chicken breasts were delivered frozen
This bloody spreadsheet crashed on me twice
Nobody likes the new parking rules
The disease spreads in warm weather
Please beat the eggs before you add the sugar""".splitlines()
